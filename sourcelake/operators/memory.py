"""Memory rules: what is opened and not closed, grows and never shrinks, or is made anew in a loop.

All kinds come from one pass over the lines of a file, in an Arrow function, which
carries state from line to line as a reader would: a region is on if the last event
before a line turned it on; a depth never falls below zero; a loop is a segment of
lines that ends where its braces are closed.  A row for each finding goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from sourcelake.functions import rows as rw
from sourcelake.functions import text as tx
from sourcelake.session import written

# Types, marks, patterns, distances, severities, confidences and texts.
RESOURCES = (
    "InputStream", "OutputStream", "Reader", "Writer", "BufferedReader", "BufferedWriter", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter",
    "Connection", "Statement", "PreparedStatement", "ResultSet", "Socket", "ServerSocket", "Channel", "RandomAccessFile", "Scanner", "PrintWriter",
    "DataInputStream", "DataOutputStream", "ObjectInputStream", "ObjectOutputStream", "ZipInputStream", "GZIPInputStream", "HttpURLConnection", "HttpClient",
    "CloseableHttpClient", "Response",
)
_TYPES = "|".join(sorted(RESOURCES, key=len, reverse=True))
OPENED = (rf"(\w+)\s*=\s*(?:new\s+)?(?:{_TYPES})\s*\(", rf"(\w+)\s*=\s*\w+\.(?:get|open|create|new)(?:{_TYPES})\s*\(")
CLOSED = r"(\w+)\.close\s*\("
FINALLY_AHEAD = 10
GUARDED = ("try (", "try(", ".use {", ".use{")
STATIC_MARKS = ("companion object", "static {", "static final")
_MADE = r"(?:mutable(?:List|Map|Set)Of|ArrayList|HashMap|HashSet|LinkedList|ConcurrentHashMap|CopyOnWriteArrayList)\b"
STATIC = rf"(?:static|companion).*(?:val|var|final)\s+(\w+)\s*[=:]\s*{_MADE}"
IN_STATIC = rf"(?:val|var)\s+(\w+)\s*=\s*{_MADE}"
JAVA_STATIC = r"static\s+.*(?:List|Map|Set|Collection)<.*>\s+(\w+)\s*=\s*new\s+"
STATIC_BEHIND = 20
GROWS, SHRINKS = (".add(", ".put(", " +=", ".addAll("), (".clear()", ".remove(", ".removeAll(", ".removeIf(")
CACHE = r"(\w*[Cc]ache\w*)\s*[=:]\s*(?:mutable)?(?:Map|HashMap|ConcurrentHashMap|LinkedHashMap)"
EVICTION = ("maximumSize", "expireAfter", "removeEldest", "maxSize", "evict", "LRU", "Caffeine", "Guava")
CACHE_BEHIND, CACHE_AHEAD = 5, 19
ANY_LOOP, PLAIN_LOOP = r"^(?:for|while|do)\s*[\({]", r"^(?:for|while)\s*[\({]"
ALLOCATED = r"new\s+\w+\[(\d+)\]|(?:Array|ByteArray|IntArray)\((\d+)\)|StringBuilder\s*\(|StringBuffer\s*\(|new\s+(?:ArrayList|HashMap|HashSet|LinkedList)\s*\(|(?:mutableListOf|mutableMapOf|mutableSetOf|arrayListOf)\s*\("
CONCATENATED = r'\w\s*\+=\s*"|\w\s*=\s*\w+\s*\+\s*"'
MAKES = ("new ", "listOf(", "mapOf(", "Pair(", "Triple(", "arrayOf(")
CALLS = r"\w\(.*\)\s*$"
MANY_MADE = 5
ADDED = (
    "addListener", "addEventListener", "addObserver", "addCallback", "subscribe", "register", "on(", "addHandler", "addPropertyChangeListener",
    "addActionListener", "addChangeListener", "addDocumentListener",
)
REMOVED = {
    "addListener": "removeListener", "addEventListener": "removeEventListener", "addObserver": "removeObserver", "addCallback": "removeCallback", "subscribe": "unsubscribe",
    "register": "unregister", "on(": "off(", "addHandler": "removeHandler", "addPropertyChangeListener": "removePropertyChangeListener",
    "addActionListener": "removeActionListener", "addChangeListener": "removeChangeListener", "addDocumentListener": "removeDocumentListener",
}
CLEANUP = ("Disposable", "AutoCloseable", "onDestroy", "onCleared", "dealloc", "componentWillUnmount")
FINALIZE = r"fun(?:ction)?\s+finalize\s*\("
KINDS = {
    "RESOURCE_LEAK": ("ERROR", 0.8, "Resource '%' opened but may not be closed. This can cause memory leaks and file descriptor exhaustion.", "Use try-with-resources (Java) or .use { } (Kotlin) to ensure the resource is closed."),
    "STATIC_COLLECTION_GROWTH": ("ERROR", 0.85, "Static collection '%' has items added but never removed/cleared. This will grow unbounded and cause heap memory to increase continuously.", "Add a cleanup mechanism: periodic clear(), bounded size with eviction, or use WeakReference."),
    "UNBOUNDED_CACHE": ("ERROR", 0.75, "Cache '%' has no eviction policy or size limit. It will grow until OutOfMemoryError.", "Use Caffeine/Guava cache with maximumSize() and expireAfterWrite(), or implement LRU eviction."),
    "ALLOCATION_IN_LOOP": ("WARNING", 0.8, "Object allocation inside loop (started at line %). Creates GC pressure — consider reusing or allocating outside the loop.", "Move allocation outside the loop and reuse the object, or use object pooling for expensive objects."),
    "STRING_CONCAT_IN_LOOP": ("WARNING", 0.9, "String concatenation inside loop creates a new String object on every iteration, generating garbage. Use StringBuilder instead.", "Use StringBuilder.append() inside the loop instead of string concatenation."),
    "LISTENER_LEAK": ("WARNING", 0.7, "Listener registered via '%' without corresponding removal. This prevents garbage collection of the listener and its enclosing object.", "Unregister the listener in onDestroy/dispose/close or use WeakReference-based listeners."),
    "GC_PRESSURE": ("WARNING", 0.7, "Loop starting at line @ creates ~% allocations per iteration. This causes significant GC pressure and heap churn.", "Reduce allocations in the loop body: reuse objects, use primitive arrays, or pre-allocate collections."),
    "THREAD_LOCAL_LEAK": ("ERROR", 0.85, "ThreadLocal created without .remove() call. In thread pool environments, this causes memory leaks as values persist across request boundaries.", "Always call threadLocal.remove() in a finally block, especially in thread pool / servlet environments."),
    "FINALIZE_USAGE": ("WARNING", 0.95, "Using finalize() delays garbage collection and can cause memory pressure. Objects with finalizers go through an extra GC cycle. Use AutoCloseable/try-with-resources instead.", "Implement AutoCloseable and use try-with-resources. Register a Cleaner if you need release semantics."),
}


FOUND = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("type", pa.string()), ("severity", pa.string()), ("confidence", pa.float64()), ("message", pa.string()), ("fix", pa.string())])
ALLOCATES = ("new", "Array(", "StringBu", "ListOf", "mutableMapOf", "mutableSetOf")

_OPENED = tuple(map(rw.Expression, OPENED))
_CLOSED, _STATIC, _IN_STATIC, _JAVA_STATIC, _CACHE, _ANY_LOOP, _PLAIN_LOOP, _ALLOCATED, _CONCATENATED, _CALLS, _FINALIZE = map(
    rw.Expression, (CLOSED, STATIC, IN_STATIC, JAVA_STATIC, CACHE, ANY_LOOP, PLAIN_LOOP, ALLOCATED, CONCATENATED, CALLS, FINALIZE)
)


class Line(NamedTuple):
    line_no: int
    line: str
    t: str
    net: int
    comment: bool


def has_any(text: str, texts: tuple[str, ...]) -> bool:
    for x in texts:
        if x in text:
            return True
    return False


def issue(kind: str, line_no: int, name: str = "") -> tuple:
    """(line_no, type, severity, confidence, message, fix); ``%`` in a text is the name, ``@`` the line."""
    severity, sure, told, fix = KINDS[kind]
    return line_no, kind, severity, sure, told.replace("@", str(line_no)).replace("%", name), fix


def abreast(lines: list[Line], values: list) -> list:
    """Running values up to lines; lines that come twice have equal numbers, and each holds what is beside it."""
    for i in range(len(lines) - 2, -1, -1):
        if lines[i].line_no == lines[i + 1].line_no:
            values[i] = values[i + 1]
    return values


def switched_on(turns_on: list[bool], turns_off: list[bool]) -> list[bool]:
    """Is a region on at a line?  The line that turns it on belongs to it, and so does the one that turns it off."""
    out, on = [], False
    for starts, ends in zip(turns_on, turns_off, strict=True):
        out.append(starts or on)
        on = starts or (on and not ends)
    return out


def guarded(lines: list[Line], whole: str) -> list[bool]:
    if not has_any(whole, GUARDED):
        return [False] * len(lines)
    return switched_on([not x.comment and has_any(x.t, GUARDED) for x in lines], [not x.comment and x.t == "}" for x in lines])


def static(lines: list[Line], whole: str) -> list[bool]:
    if not has_any(whole, STATIC_MARKS):
        return [False] * len(lines)
    sums = [0, *accumulate(x.net for x in lines)]
    recent = [sums[i + 1] - sums[max(i - STATIC_BEHIND, 0)] for i in range(len(lines))]
    return switched_on([has_any(x.t, STATIC_MARKS) for x in lines], [x.t == "}" and x.line_no > 1 and r <= 0 for x, r in zip(lines, recent, strict=True)])


def begins_loop(t: str, plain: rw.Expression, marks: tuple[str, ...]) -> bool:
    return (t.startswith(("for", "while", "do")) and plain.found(t)) or has_any(t, marks)


def resource_leaks(path: str | None, lines: list[Line], whole: str) -> Iterator[tuple]:
    """Resources whose last opening no closing follows; a finally block closes what its next ten lines close."""
    opened, closed, on = {}, {}, None
    for i, x in enumerate(lines):
        if "=" in x.t and "(" in x.t and not x.comment and has_any(x.t, RESOURCES):
            names = [name for p in _OPENED for name in p.every(x.t)]
            if names and on is None:
                on = guarded(lines, whole)
            if names and not on[i]:
                opened |= dict.fromkeys(names, x.line_no)
    if not opened:
        return
    if path is not None and ".close" in whole:
        closes = [_CLOSED.first(x.t) if ".close" in x.t else "" for x in lines]
        for i, x in enumerate(lines):
            if x.comment or on[i]:
                continue
            if closes[i]:
                closed[closes[i]] = max(closed.get(closes[i], 0), x.line_no)
            if x.t.startswith("finally"):
                for k in range(i + 1, len(lines)):
                    if lines[k].line_no > x.line_no + FINALLY_AHEAD or (lines[k].t == "}" and lines[k].line_no > x.line_no):
                        break
                    if closes[k] and lines[k].line_no > x.line_no:
                        closed[closes[k]] = max(closed.get(closes[k], 0), x.line_no)
    for name, n in opened.items():
        if closed.get(name, 0) < n:
            yield issue("RESOURCE_LEAK", n, name)


def static_growth(lines: list[Line], whole: str) -> Iterator[tuple]:
    """Collections of static regions that some line from their first on adds to, and none takes from."""
    made, on = {}, static(lines, whole)
    for x, inside in zip(lines, on, strict=True):
        if inside or "static" in x.t or "companion" in x.t:
            plain = _STATIC.first(x.t)
            for name in (plain, _IN_STATIC.first(x.t) if plain == "" and inside else "", _JAVA_STATIC.first(x.t)):
                if name:
                    made[name] = (made.get(name, (x.line_no,))[0], x.line_no)
    if not made:
        return
    used = [x for x in lines if has_any(x.t, GROWS) or has_any(x.t, SHRINKS)]
    for name, (since, n) in made.items():
        mine = [x.t for x in used if name in x.t and x.line_no >= since]
        grows, shrinks = (tuple(name + mark for mark in marks) for marks in (GROWS, SHRINKS))
        if any(has_any(t, grows) for t in mine) and not any(has_any(t, shrinks) for t in mine):
            yield issue("STATIC_COLLECTION_GROWTH", n, name)


def unbounded_caches(lines: list[Line]) -> Iterator[tuple]:
    for i, x in enumerate(lines):
        if "ache" in x.t and (name := _CACHE.first(x.t)) and not any(has_any(y.line, EVICTION) for y in lines[max(i - CACHE_BEHIND, 0) : i + CACHE_AHEAD + 1]):
            yield issue("UNBOUNDED_CACHE", x.line_no, name)


def allocations(lines: list[Line]) -> Iterator[tuple]:
    """Allocations in loops and braces, with the line that began the outermost loop."""
    found = {i for i, x in enumerate(lines) if has_any(x.t, ALLOCATES) and _ALLOCATED.found(x.t)}
    if not found:
        return
    loops = [begins_loop(x.t, _ANY_LOOP, (".forEach", ".map {", ".flatMap", ".filter {")) for x in lines]
    total = abreast(lines, list(accumulate(x.net + loop for x, loop in zip(lines, loops, strict=True))))
    least = abreast(lines, list(accumulate(total, min)))
    depth = [0, *(a - min(b, 0) for a, b in zip(total, least, strict=True))]
    began = abreast(lines, list(accumulate((x.line_no if loop and d == 0 else 0 for x, loop, d in zip(lines, loops, depth, strict=False)), lambda a, b: b or a)))
    for i in found:
        if depth[i] + loops[i] > 0:
            yield issue("ALLOCATION_IN_LOOP", lines[i].line_no, str(began[i]))


def loop_segments(lines: list[Line], loops: list[bool]) -> Iterator[list[tuple[Line, int]]]:
    """Lines of each loop with the braces open after the line since the loop began, until they are closed."""
    segment = abreast(lines, list(accumulate(loops)))
    i = 0
    while i < len(lines):
        end = i
        while end < len(lines) and segment[end] == segment[i]:
            end += 1
        if segment[i]:
            rows = lines[i:end]
            inner = abreast(rows, list(accumulate(x.net for x in rows)))
            last = next((k for k, n in enumerate(inner) if n <= 0), len(rows) - 1)
            yield list(zip(rows[: last + 1], inner, strict=False))
        i = end


def makes(t: str) -> bool:
    return has_any(t, MAKES) or (")" in t and t[0].upper() == t[0] != t[0].lower() and _CALLS.found(t))


def loop_work(lines: list[Line], whole: str) -> Iterator[tuple]:
    """String concatenations in loops, and loops that make many objects."""
    if '"' in whole and "=" in whole:
        loops = [begins_loop(x.t, _PLAIN_LOOP, (".forEach",)) for x in lines]
        for segment in loop_segments(lines, loops) if any(loops) else ():
            for x, _ in segment:
                if '"' in x.t and "=" in x.t and _CONCATENATED.found(x.t):
                    yield issue("STRING_CONCAT_IN_LOOP", x.line_no)
    loops = [begins_loop(x.t, _PLAIN_LOOP, (".forEach", ".map {")) for x in lines]
    for segment in loop_segments(lines, loops) if any(loops) else ():
        made = sum(makes(x.t) for x, _ in segment) if len(segment) >= MANY_MADE else 0
        if made >= MANY_MADE and min(inner for _, inner in segment) <= 0:
            yield issue("GC_PRESSURE", segment[0][0].line_no, str(made))


def listener_leaks(lines: list[Line], whole: str) -> Iterator[tuple]:
    """Last lines that register a listener, in files that never remove one of that kind and have no clean-up."""
    if has_any(whole, CLEANUP):
        return
    for mark, removes in REMOVED.items():
        if mark in whole and removes not in whole:
            last = max((x.line_no for x in lines if mark in x.t), default=None)
            if last is not None:
                yield issue("LISTENER_LEAK", last, mark)


def findings_of(path: str | None, rows: list[tuple[int, str, str | None]]) -> list[tuple]:
    """All findings of a file; without a path, nothing is closed and no collection is added to."""
    whole = "\n".join([line for _, line, _ in rows])
    lines = []
    for n, line, _ in rows:
        t = line.strip(tx.WHITESPACE)
        lines.append(Line(n, line, t, t.count("{") - t.count("}"), t.startswith(("//", "*", "/*"))))
    parts = [loop_work(lines, whole), listener_leaks(lines, whole)]
    # most files have none of these texts, without which there is nothing to find
    if has_any(whole, RESOURCES):
        parts.append(resource_leaks(path, lines, whole))
    if path is not None and has_any(whole, ("static", "companion")):
        parts.append(static_growth(lines, whole))
    if "ache" in whole:
        parts.append(unbounded_caches(lines))
    if has_any(whole, ALLOCATES):
        parts.append(allocations(lines))
    if has_any(whole, ("new ThreadLocal", "ThreadLocal<")) and ".remove()" not in whole:
        parts.append(issue("THREAD_LOCAL_LEAK", x.line_no) for x in lines if "new ThreadLocal" in x.line or "ThreadLocal<" in x.line)
    if "finalize" in whole:
        parts.append(issue("FINALIZE_USAGE", x.line_no) for x in lines if "finalize" in x.t and _FINALIZE.found(x.t))
    return [(path, *found) for part in parts for found in part]


def memory_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, type, severity, confidence, message, fix) of nine kinds.

    A file without text has none.  Further columns are not read.
    """
    # what is found is held in columns, as it may be read more than once
    return written(rw.mapped(files, findings_of, FOUND), "findings")
