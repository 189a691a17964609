"""Method extraction and cyclomatic / cognitive complexity, inside the row.

Methods are found greedily: a declaration opens a method, and scanning resumes
after the method's last line.  Two walks over the file's lines do that in linear
time, in an Arrow function: a backward one finds the declarations whose braces
never close, a forward one goes through the rest.  Only lines of methods are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions import rows as rw
from sourcelake.functions import text as tx

# Keyword sets.  Short ones count every occurrence, longer ones once per line.
BRANCH_SHORT = ("if", "do", "&&", "||", "or", "??")
BRANCH_WORDS = ("else if", "elif", "elsif", "elseif", "case", "when", "for", "foreach", "while",
                "catch", "except", "rescue", "and")
NESTING_WORDS = ("if", "else if", "elif", "elsif", "elseif", "for", "foreach", "while", "do",
                 "switch", "match", "catch", "except", "rescue")
FLAT_WORDS = ("else", "break", "continue", "goto")
NOT_METHODS = ("if", "for", "while", "switch", "catch", "class", "interface", "enum")
NOT_DECLARING = ("//", "/*", "*", "import ", "package ", "from ", "using ")
INDENT_LANGUAGES = ("python", "ruby")

_NAME = r"([A-Za-z_]\w*)"
# A declaration is a name with a parameter list after a type, modifier
# or keyword; then the forms with their own keyword.
DECLARATIONS = (
    rf"[A-Za-z_<>\[\]?,\s]\s+{_NAME}\s*\(([^)]*)\)",
    rf"def\s+{_NAME}\s*\(([^)]*)\)\s*(?:->.*)?:",
    rf"func\s+(?:\([^)]*\)\s+)?{_NAME}\s*\(([^)]*)\)",
    r"def\s+([A-Za-z_]\w*[?!]?)\s*(?:\(([^)]*)\))?",
    rf"fn\s+{_NAME}\s*(?:<[^>]*>)?\s*\(([^)]*)\)",
    rf"function\s+{_NAME}\s*\(([^)]*)\)",
)


# -- per-line scores --------------------------------------------------------

def mask_strings(line: Column) -> Column:
    """Blank what sits inside quotes; an unclosed quote blanks the rest.

    The opening quote stays so that positions keep their meaning.
    """
    plain = F.regexp_replace(line, r"(?<=\\)[\"']", "_")  # an escaped quote is no quote
    blanked = F.regexp_replace(plain, r"""\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)""", '""')
    return F.when(line.contains('"') | line.contains("'"), blanked).otherwise(line)


def _word(keyword: str) -> str:
    return rf"(?<![\p{{L}}\p{{Nd}}_]){keyword}(?![\p{{L}}\p{{Nd}}_])"


def _occurrences(col: Column, literal: str) -> Column:
    rest = F.replace(col, F.lit(literal), F.lit(""))
    return F.floor((F.length(col) - F.length(rest)) / len(literal)).cast("int")


def branch_points(line: Column) -> Column:
    """Decision points of one trimmed, lower-cased, masked line."""
    total = F.lit(0)
    for keyword in BRANCH_SHORT:
        total = total + _occurrences(line, keyword)
    for keyword in BRANCH_WORDS:
        total = total + F.when(line.contains(keyword), line.rlike(_word(keyword)).cast("int")).otherwise(0)
    return F.when(tx.starts_any(line, ("//", "#", "*")), 0).otherwise(total)


def nesting_word(line: Column) -> Column:
    return line.rlike(_word("(?:" + "|".join(NESTING_WORDS) + ")"))


def line_scores(lines: Column) -> Column:
    """array<struct> of what methods need per line, computed once per file."""
    words = {name: _word("(?:" + "|".join(w) + ")") for name, w in (("nest", NESTING_WORDS), ("flat", FLAT_WORDS))}

    def read(l):
        t = tx.trim(l)
        return F.struct(l.alias("l"), t.alias("t"), mask_strings(F.lower(t)).alias("low"))

    def judge(x):
        skip = (x["t"] == "") | tx.starts_any(x["t"], ("//", "#", "*"))
        return F.struct(
            x["l"].alias("l"), x["t"].alias("t"), x["low"].alias("low"), skip.alias("skip"),
            x["low"].rlike(_word("try")).alias("tries"), x["low"].rlike(words["nest"]).alias("nests"),
            x["low"].rlike(words["flat"]).alias("flat"),
        )

    def score(x, i):
        nests = ~x["tries"] & x["nests"]
        flat = ~x["tries"] & ~nests & x["flat"]
        return F.struct(
            (i + 1).cast("int").alias("n"),
            tx.count_of(x["l"], "{").alias("opens"),
            tx.count_of(x["l"], "}").alias("closes"),
            tx.brace_low(x["l"]).alias("low"),
            tx.indent(x["l"]).alias("indent"),
            branch_points(x["low"]).alias("branches"),
            F.when(~x["skip"] & nests, 1).otherwise(0).alias("nest_hit"),
            F.when(x["skip"], 0).otherwise(
                flat.cast("int") + _occurrences(x["low"], "&&") + _occurrences(x["low"], "||")
            ).alias("flat_hit"),
            x["skip"].alias("skip"),
        )

    # staged, because a lambda evaluates each mention of a value again
    return F.transform(F.transform(F.transform(lines, read), judge), score)


def cognitive(scores: Column) -> Column:
    """Nesting-weighted score; nesting is the clamped brace depth before a line."""
    def step(acc, s):
        net = s["opens"] - s["closes"]
        after = F.greatest(acc["nest"] + net, net - s["low"])
        return {
            "total": acc["total"] + F.when(s["nest_hit"] == 1, 1 + acc["nest"]).otherwise(0) + s["flat_hit"],
            "nest": F.when(s["skip"], acc["nest"]).otherwise(after),
        }

    return tx.struct_fold(scores, {"nest": F.lit(0), "total": F.lit(0)}, step, "total")


def cyclomatic(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(1), lambda acc, s: acc + s["branches"])


def max_nesting(scores: Column) -> Column:
    """Deepest of brace depth and indent / 4 over the lines that count."""
    def step(acc, s):
        net = s["opens"] - s["closes"]
        after = F.when(s["skip"], acc["nest"]).otherwise(F.greatest(acc["nest"] + net, net - s["low"]))
        by_indent = F.when(s["skip"] | s["brace_first"], 0).otherwise(F.floor(s["indent"] / 4).cast("int"))
        return {"nest": after, "deepest": F.greatest(acc["deepest"], F.when(s["skip"], 0).otherwise(after), by_indent)}

    return tx.struct_fold(scores, {"nest": F.lit(0), "deepest": F.lit(0)}, step, "deepest")


# -- greedy extraction ------------------------------------------------------

#: Declarations with a text that every match holds: lines without it are not tried.
_DECLARES = tuple(zip(("(", "def", "func", "def", "fn", "function"), map(rw.Expression, DECLARATIONS), strict=True))
_SELF, _THIS = rw.Expression(r"^\s*self\s*,?\s*"), rw.Expression(r"^\s*this\s*,?\s*")
_ESCAPED, _QUOTED = re.compile(r"(?<=\\)[\"']"), re.compile(r"""\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)""")
_BRANCHES = tuple((w, rw.Expression(_word(w))) for w in BRANCH_WORDS)
_TRY, _NESTS, _FLAT = (rw.Expression(_word("(?:" + "|".join(w) + ")")) for w in (("try",), NESTING_WORDS, FLAT_WORDS))
#: Every word that nests holds one of these.
_NESTS_IN = tuple(w for w in NESTING_WORDS if not any(v in w and v != w for v in NESTING_WORDS))
COMMENTS = ("//", "#", "*")
FOUND = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("line_count", pa.int32()), ("param_count", pa.int32()),
    ("cyclomatic", pa.int32()), ("cognitive", pa.int32()),
])


class Line(NamedTuple):
    n: int
    line: str
    t: str
    opens: int
    net: int
    declares: tuple[str, str] | None


class Span(NamedTuple):
    start: int
    end: int
    name: str
    params: str


def declared(line: str) -> tuple[str, str] | None:
    """Name and parameters of the method that a trimmed line declares."""
    if line.startswith(NOT_DECLARING) or not ("(" in line or "def" in line):
        return None
    for held, pattern in _DECLARES:
        if held in line:
            found = pattern.groups(line)
            if found and found[0] and found[0] not in NOT_METHODS:
                return found[0], found[1]
    return None


def parameter_count(params: str) -> int:
    cleaned = _THIS.replaced(_SELF.replaced(params.strip(tx.WHITESPACE), ""), "")
    return sum(p.strip(tx.WHITESPACE) != "" for p in cleaned.split(","))


def unclosed(lines: list[Line]) -> set[int]:
    """Lines of declarations whose block never returns to its own depth.

    ``low`` is the least balance reached from a line on, ``since`` the same but
    only from the next '{' on.
    """
    low, since, found = 0, None, set()
    for x in reversed(lines):
        low = x.net + min(0, low)
        since = low if x.opens else None if since is None else x.net + since
        if x.declares and (since is None or since > 0):
            found.add(x.n)
    return found


def brace_spans(lines: list[Line]) -> Iterator[Span]:
    never, begun, depth, opened, resume = unclosed(lines), None, 0, False, 1
    for x in lines:
        if begun is None:
            if not x.declares or x.n < resume:
                continue
            if x.n in never:
                resume = min(x.n + 1, len(lines)) + 1
                yield Span(x.n, resume - 1, *x.declares)
                continue
            begun, depth, opened = x, 0, False
        depth, opened = depth + x.net, opened or x.opens > 0
        if opened and depth <= 0:
            yield Span(begun.n, x.n, *begun.declares)
            begun = None


def indent_of(line: str) -> int:
    return len(line) - len(line.lstrip(tx.WHITESPACE))


def indent_spans(lines: list[Line]) -> Iterator[Span]:
    """A method ends before the next non-blank line that is not deeper.

    That line is examined again as a possible declaration itself.
    """
    begun, indent = None, 0
    for x in lines:
        if begun is not None and x.t != "" and indent_of(x.line) <= indent:
            yield Span(begun.n, x.n - 1, *begun.declares)
            begun = None
        if begun is None and x.declares:
            begun, indent = x, indent_of(x.line)
    if begun is not None:
        yield Span(begun.n, len(lines), *begun.declares)


def masked(line: str) -> str:
    """``mask_strings`` of one line."""
    return _QUOTED.sub('""', _ESCAPED.sub("_", line)) if '"' in line or "'" in line else line


def lowest(line: str) -> int:
    """``text.brace_low`` of one line."""
    at = low = 0
    if "}" in line:
        for c in line:
            at += (c == "{") - (c == "}")
            low = min(low, at)
    return low


def complexity(body: list[Line]) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of lines, as the scores of columns above."""
    cyclomatic, cognitive, nest = 1, 0, 0
    for x in body:
        low = masked(x.t.lower())
        if not low.startswith(COMMENTS):
            cyclomatic += sum(low.count(w) for w in BRANCH_SHORT) + sum(w in low and p.found(low) for w, p in _BRANCHES)
        if x.t == "" or x.t.startswith(COMMENTS):
            continue
        tries = "try" in low and _TRY.found(low)
        nests = not tries and any(w in low for w in _NESTS_IN) and _NESTS.found(low)
        flat = not tries and not nests and any(w in low for w in FLAT_WORDS) and _FLAT.found(low)
        cognitive += (1 + nest if nests else 0) + flat + low.count("&&") + low.count("||")
        nest = max(nest + x.net, x.net - lowest(x.line))
    return cyclomatic, cognitive


def methods_of(path: str | None, language: str | None, texts: list[str]) -> Iterator[tuple]:
    lines = []
    for n, line in enumerate(texts, 1):
        t, opens = line.strip(tx.WHITESPACE), line.count("{")
        lines.append(Line(n, line, t, opens, opens - line.count("}"), declared(t)))
    for s in indent_spans(lines) if language in INDENT_LANGUAGES else brace_spans(lines):
        yield path, language, s.name, s.start, s.end, s.end - s.start + 1, parameter_count(s.params), *complexity(lines[s.start - 1 : s.end])


def method_table(files: DataFrame) -> DataFrame:
    """One row per method."""
    return rw.each(files, methods_of, FOUND)


def file_complexity(files: DataFrame) -> DataFrame:
    """Whole-file cyclomatic and cognitive scores and deepest nesting."""
    scored = tx.with_lines(files).withColumn("scores", line_scores(F.col("lines")))
    flagged = F.transform(
        F.arrays_zip(F.col("scores").alias("s"), F.col("lines").alias("l")),
        lambda z: z["s"].withField("brace_first", tx.starts_any(tx.trim(z["l"]), ("{", "}"))),
    )
    return scored.select(
        "path",
        cyclomatic(F.col("scores")).alias("cyclomatic"),
        cognitive(F.col("scores")).alias("cognitive"),
        max_nesting(flagged).alias("max_nesting"),
    )
