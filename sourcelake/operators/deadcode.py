"""Dead code: names that nothing uses, code that never runs, blocks that hold nothing.

All ten kinds come from one pass over the lines of a file, in an Arrow function:
neither lines nor words are shuffled or written, a row for each issue goes on.
Braces are paired with a running depth: at one level of depth, opening and
closing braces take turns, so the next brace of a level closes the one before.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from sourcelake.functions import rows as rw
from sourcelake.functions import text as tx
from sourcelake.operators import scan

# Patterns, keywords, severities, confidences and messages.
IMPORT = r"^\s*import\s+(.+)$"
ALIAS = r"^(.+)\s+as\s+(\w+)$"
VARIABLE = r"^\s*(?:val|var|let|const|final)\s+(\w+)"
METHOD = r"^\s*(?:(?:public|protected|internal|private|open|override|abstract|suspend|inline|static|final|synchronized)\s+)*fun\s+(\w+)\s*\(([^)]*)\)"
PRIVATE_METHOD = r"^\s*private\s+(?:(?:suspend|inline)\s+)*fun\s+(\w+)\s*\("
CATCH = (r"^\s*\}\s*catch\s*\(", r"catch\s*\([^)]*\)\s*\{")
NULL_CHECK = r"if\s*\(\s*(\w+)\s*!=\s*null\s*\)"
NON_NULL = r"^\s*(?:val|var)\s+(\w+)\s*:\s*([A-Z]\w+)(?:\s*=|$)"
CONDITION = r"(?:if|while)\s*\(\s*(true|false)\s*\)"
CODE_LIKE = r"\b(if|for|while|return|val|var|fun|class|def|function|import|public|private)\b|[=;{})]\s*$"
JUMPS = ("return", "throw", "break", "continue")
AFTER_JUMP = ("}", "catch", "finally", "else", ")")
PARAMETER_MARKS = ("vararg ", "noinline ", "crossinline ")
KINDS = {
    "UNUSED_IMPORT": ("INFO", 0.9, "Import '%' is not used in the file."),
    "UNUSED_VARIABLE": ("WARNING", 0.8, "Variable '%' is declared but never referenced elsewhere in the file."),
    "UNUSED_PARAMETER": ("WARNING", 0.75, "Parameter '%' in method '@' is never used in the method body."),
    "UNREACHABLE_CODE": ("WARNING", 0.85, "Code after '@' is unreachable."),
    "EMPTY_CATCH": ("WARNING", 0.95, "Empty catch block swallows exception silently."),
    "EMPTY_METHOD": ("INFO", 0.9, "Method '%' has an empty body."),
    "COMMENTED_CODE": ("INFO", None, "@ consecutive commented lines with code-like patterns detected."),
    "UNUSED_PRIVATE_METHOD": ("WARNING", 0.85, "Private method '%' is never called within the file."),
    "REDUNDANT_NULL_CHECK": ("INFO", 0.8, "Null check on '%' is redundant — it is declared as non-nullable."),
    "DEAD_CONDITIONAL": (None, 0.95, "Condition '%' is always @ — this is dead or trivial code."),
}
FIXES = {
    "UNUSED_IMPORT": "Remove unused import '%'.",
    "UNUSED_VARIABLE": "Remove unused variable '%' or prefix with '_' if intentionally unused.",
    "UNUSED_PARAMETER": "Remove unused parameter '%' or prefix with '_' if required by interface.",
    "UNREACHABLE_CODE": "Remove unreachable code after the terminating statement.",
    "EMPTY_CATCH": "Handle the exception or add a comment explaining why it is ignored.",
    "EMPTY_METHOD": "Implement the method body or remove it if unnecessary.",
    "COMMENTED_CODE": "Remove commented-out code; use version control instead.",
    "UNUSED_PRIVATE_METHOD": "Remove unused private method '%'.",
    "REDUNDANT_NULL_CHECK": "Remove the redundant null check on '%' — it cannot be null.",
    "DEAD_CONDITIONAL": "Simplify or remove the dead conditional '%'.",
}
#: Lines from a declaration on in which its block may begin.
BLOCK_WITHIN = 4
WORD = r"\w+"
CALL = r"(?<!fun\s)\b(\w+)\s*[(<]"


FOUND = pa.schema([
    ("path", pa.string()), ("line_no", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("severity", pa.string()), ("confidence", pa.float64()), ("message", pa.string()), ("fix", pa.string()),
])

_IMPORT, _ALIAS, _VARIABLE, _METHOD, _PRIVATE, _NULL, _NON_NULL, _CONDITION, _CODE, _CALL = map(
    rw.Expression, (IMPORT, ALIAS, VARIABLE, METHOD, PRIVATE_METHOD, NULL_CHECK, NON_NULL, CONDITION, CODE_LIKE, CALL)
)
_CATCH = tuple(map(rw.Expression, CATCH))
_WORDS, _BRACES = re.compile(WORD, re.ASCII), re.compile("[{}]")
_ONE_WORD, _LAST_WORD, _SEMICOLON = rw.Expression(r"^\w+$"), rw.Expression(r"(?:^|\s)(\S*)$"), rw.Expression(";$")
_INTERFACE = {language: (held, rw.Expression(p)) for languages, (held, p) in scan._INTERFACE_DECL.items() for language in languages}
_JUMPS = tuple(f"{w}{mark}" for w in JUMPS for mark in (" ", ";", "("))
_TEXTS = {kind: tuple(re.split("([%@])", text) for text in (KINDS[kind][2], FIXES[kind])) for kind in KINDS}


class Line(NamedTuple):
    line_no: int
    line: str
    t: str


class Block(NamedTuple):
    """Pieces after ``begin`` up to ``end``, counted from one."""

    begin: int
    end: int
    empty: bool


class Method(NamedTuple):
    line_no: int
    t: str
    name: str
    params: str
    block: Block


def issue(kind: str, line_no: int, name: str, other: str = "", severity: str | None = None, sure: float | None = None) -> tuple:
    """(line_no, type, name, severity, confidence, message, fix); in a text ``%`` is the name and ``@`` something else."""
    level, confidence, _ = KINDS[kind]
    message, fix = ("".join([name if p == "%" else other if p == "@" else p for p in parts]) for parts in _TEXTS[kind])
    return line_no, kind, name, severity or level, confidence if sure is None else sure, message, fix


def declares_interface(rows: list[tuple[int, str, str | None]]) -> bool:
    for _, line, language in rows:
        held, pattern = _INTERFACE.get(language, (None, None))
        if held and held in line and pattern.found(line.strip(tx.WHITESPACE)):
            return True
    return False


def has_word(text: str, word: str) -> bool:
    return word in text and word in _WORDS.findall(text)


def read_blocks(lines: list[Line]) -> tuple[list[str], dict[int, Block]]:
    """What lies between braces and line ends, in order; and the first block that opens on each line, if it is closed."""
    found = []
    for n, line, t in lines:
        if "{" in line or "}" in line:
            found += [(n, k, piece, brace) for k, (piece, brace) in enumerate(zip(_BRACES.split(line), [*(c for c in line if c in "{}"), None], strict=True))]
        else:
            found.append((n, 0, line, None))
    if any(a[0] == b[0] for a, b in zip(lines, lines[1:])):
        # lines that come twice have equal numbers: their pieces take turns, and sums up to one hold those beside it
        found.sort(key=itemgetter(0, 1))
        steps = [list(beside) for _, beside in groupby(found, key=itemgetter(0, 1))]
    else:
        steps = ((piece,) for piece in found)
    first, last = {}, {}
    filled = braces = depth = seq = 0
    for beside in steps:
        for _, _, piece, brace in beside:
            if piece.strip(tx.WHITESPACE):
                filled += 1
            if brace:
                braces += 1
                depth += 1 if brace == "{" else -1
        for n, _, _, brace in beside:
            seq += 1
            if brace:
                level = depth + (brace == "}")
                before = last.get(level)
                if before and before["open"]:
                    before["block"] = Block(before["seq"], seq, filled == before["filled"] and braces == before["braces"] + 1)
                last[level] = at = {"open": brace == "{", "seq": seq, "filled": filled, "braces": braces, "block": None}
                if brace == "{":
                    first.setdefault(n, at)
    return [piece for _, _, piece, _ in found], {n: at["block"] for n, at in first.items() if at["block"]}


def opens_at(lines: list[Line], i: int) -> int | None:
    """The next line with an opening brace, from a line on, if it is near."""
    return next((x.line_no for x in lines[i : i + BLOCK_WITHIN] if "{" in x.line), None)


def unused_imports(lines: list[Line], among: list[Line]) -> Iterator[tuple]:
    """Imports whose last segment, or alias, is no word below the last import; wildcards are left out."""
    rows = []
    for x in lines:
        if "import" in x.line and (got := _IMPORT.groups(x.line)):
            name = _SEMICOLON.replaced(got[0].strip(tx.WHITESPACE), "")
            if not name.endswith(".*"):
                alias = _ALIAS.groups(name)
                rows.append((x.line_no, name, alias[1] if alias else name.rsplit(".", 1)[-1]))
    if not rows:
        return
    last = max(n for n, *_ in rows)
    below = [x.line for x in among if x.line_no > last]
    words = set(_WORDS.findall("\n".join(below)))
    for n, name, symbol in rows:
        if symbol.strip(tx.WHITESPACE) == "":
            continue
        if _ONE_WORD.found(symbol):
            used = symbol in words
        else:  # a symbol of several words or with marks is looked for as text
            quoted = rw.Expression(rf"\b{re.escape(symbol)}\b")
            used = any(symbol in line and quoted.found(line) for line in below)
        if not used:
            yield issue("UNUSED_IMPORT", n, name)


def unused_variables(lines: list[Line], among: list[Line], whole: str) -> Iterator[tuple]:
    """Variables whose name is on one line of the file only."""
    rows = [(x.line_no, name) for x in lines if x.t.startswith(("val", "var", "let", "const", "final")) and len(name := _VARIABLE.first(x.line)) > 1 and not name.startswith("_")]
    if not rows or not among:
        return
    words = Counter(_WORDS.findall(whole))
    for n, name in rows:
        # a word that comes again may come on the same line
        if words[name] == 1 or len(list(islice((x for x in among if has_word(x.line, name)), 2))) == 1:
            yield issue("UNUSED_VARIABLE", n, name)


def unused_private_methods(lines: list[Line], among: list[Line]) -> Iterator[tuple]:
    """Private methods without a call on another line of the file."""
    declared = [(x.line_no, name) for x in lines if x.t.startswith("private") and (name := _PRIVATE.first(x.line))]
    if not declared:
        return
    names, calls = {name for _, name in declared}, defaultdict(set)
    for x in among:
        if "(" in x.line or "<" in x.line:
            for called in names.intersection(_CALL.every(x.line)):
                calls[called].add(x.line_no)
    for n, name in declared:
        if not calls[name] - {n}:
            yield issue("UNUSED_PRIVATE_METHOD", n, name)


def parameter_name(text: str) -> str | None:
    """``name: Type`` or the last word of ``Type name``; null if that is no word."""
    if text.find(":") > 0:
        before = text.split(":", 1)[0].strip(tx.WHITESPACE)
        for mark in PARAMETER_MARKS:
            before = before.removeprefix(mark)
        return before.strip(tx.WHITESPACE)
    last = _LAST_WORD.first(text)
    return last if _ONE_WORD.found(last) else None


def methods(lines: list[Line], blocks: dict[int, Block]) -> list[Method]:
    """Declared methods that have a block."""
    out = []
    for i, x in enumerate(lines):
        if "fun" in x.line and ("{" in x.line or "=" not in x.line) and (got := _METHOD.groups(x.line)):
            block = blocks.get(opens_at(lines, i))
            if block:
                out.append(Method(x.line_no, x.t, got[0], got[1].strip(tx.WHITESPACE), block))
    return out


def unused_parameters(declared: list[Method], pieces: list[str]) -> Iterator[tuple]:
    """Parameters that are no word of their method's block; overriding methods are left out."""
    for m in declared:
        if not m.t.startswith("override") and m.params != "":
            for param in m.params.split(","):
                name = parameter_name(param.strip(tx.WHITESPACE))
                if name and not name.startswith("_") and not any(has_word(p, name) for p in pieces[m.block.begin : m.block.end] if name in p):
                    yield issue("UNUSED_PARAMETER", m.line_no, name, m.name)


def empty_blocks(lines: list[Line], declared: list[Method], blocks: dict[int, Block], interface: bool) -> Iterator[tuple]:
    """Catch blocks and methods with nothing but white space between their braces."""
    for m in declared:
        if m.block.empty and "abstract " not in m.t and (not interface or "{" in m.t):
            yield issue("EMPTY_METHOD", m.line_no, m.name)
    for i, x in enumerate(lines):
        if "catch" in x.line and any(p.found(x.line) for p in _CATCH):
            block = blocks.get(opens_at(lines, i))
            if block and block.empty:
                yield issue("EMPTY_CATCH", x.line_no, "catch")


def after_jumps(lines: list[Line]) -> Iterator[tuple]:
    """The next line that is not blank after a jump, unless it closes a block or is less indented."""
    cause = None
    for x in lines:
        if x.t == "":
            continue
        if cause and len(x.line) - len(x.line.lstrip(tx.WHITESPACE)) >= was and not x.t.startswith(AFTER_JUMP):
            yield issue("UNREACHABLE_CODE", x.line_no, x.t[:60], cause[:30])
        cause = None
        if x.t.startswith(JUMPS) and (x.t in JUMPS or x.t.startswith(_JUMPS)):
            cause, was = x.t, len(x.line) - len(x.line.lstrip(tx.WHITESPACE))


def commented_code(lines: list[Line]) -> Iterator[tuple]:
    """Runs of more than three comment lines, at least two of which look like code."""
    runs = defaultdict(list)
    for i, x in enumerate(x for x in lines if x.t.startswith("//")):
        runs[x.line_no - i].append(x)
    for run in runs.values():
        if len(run) > 3 and (code := sum(_CODE.found(x.t[2:].strip(tx.WHITESPACE)) for x in run)) >= 2:
            yield issue("COMMENTED_CODE", run[0].line_no, "comment-block", str(len(run)), sure=min(max(code / len(run), 0.5), 0.9))


def null_checks(lines: list[Line], among: list[Line]) -> Iterator[tuple]:
    """Checks against null of names that the file declares with a type that can't be null."""
    checks = [(x.line_no, name) for x in lines if "null" in x.line and (name := _NULL.first(x.line))]
    if not checks:
        return
    sure = set()
    for x in among:
        if x.t.startswith(("val", "var")) and ":" in x.line and (got := _NON_NULL.groups(x.line)) and f"{got[1]}?" not in x.line:
            sure.add(got[0])
    for n, name in checks:
        if name in sure:
            yield issue("REDUNDANT_NULL_CHECK", n, name)


def dead_conditions(lines: list[Line]) -> Iterator[tuple]:
    for x in lines:
        if ("true" in x.line or "false" in x.line) and (value := _CONDITION.first(x.line)):
            word = "while" if "while" in x.line else "if"
            if (word, value) != ("while", "true"):
                yield issue("DEAD_CONDITIONAL", x.line_no, f"{word}({value})", value, "WARNING" if value == "false" else "INFO")


def issues_of(path: str | None, rows: list[tuple[int, str, str | None]]) -> Iterable[tuple]:
    """All issues of a file; in lines without a path no name is found again."""
    whole = "\n".join([line for _, line, _ in rows])
    lines = [Line(n, line, line.strip(tx.WHITESPACE)) for n, line, _ in rows]
    among = lines if path is not None else []
    pieces, blocks = read_blocks(among) if "{" in whole else ([], {})
    declared = methods(lines, blocks) if blocks else []
    parts = [unused_variables(lines, among, whole), unused_private_methods(lines, among), unused_parameters(declared, pieces), after_jumps(lines)]
    # most files have none of these texts, without which there is nothing to find
    if "import" in whole:
        parts.append(unused_imports(lines, among))
    if blocks:
        parts.append(empty_blocks(lines, declared, blocks, declares_interface(rows)))
    if "//" in whole:
        parts.append(commented_code(lines))
    if "null" in whole:
        parts.append(null_checks(lines, among))
    if "true" in whole or "false" in whole:
        parts.append(dead_conditions(lines))
    return [(path, *found) for part in parts for found in part]


def dead_code(files: DataFrame) -> DataFrame:
    """(path, line_no, type, name, severity, confidence, message, fix) of ten kinds.

    A file without text has no issue; a path that comes twice is read as one file
    whose lines come twice.  Further columns are not read.
    """
    return rw.mapped(files, issues_of, FOUND)
