"""Column expressions over text and over the per-file array of lines.

A file is one row, so its lines never need a shuffle: look-around, running
state and name lookups are evaluated inside the row on array columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Everything a JVM calls whitespace, for btrim/ltrim.
WHITESPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
WORD = r"[\p{L}\p{Nd}_]+"


def split_lines(text: Column) -> Column:
    """Lines as a reader sees them: one final terminator ends the last line."""
    body = F.regexp_replace(text, r"(?:\r\n|\r|\n)\z", "")
    empty = F.array().cast("array<string>")
    # most texts have no other terminator than \n, and are split without trying an expression at each character
    plain = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    lines = F.when(text.contains("\r"), F.split(body, r"\r\n|\r|\n", -1)).otherwise(F.split(plain, "\n", -1))
    return F.when((text.isNull()) | (text == ""), empty).otherwise(lines)


def with_lines(files: DataFrame) -> DataFrame:
    return files if "lines" in files.columns else files.withColumn("lines", split_lines(F.col("text")))


def explode_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line), in place: posexplode is narrow."""
    return (
        with_lines(files)
        .select("path", "language", F.posexplode("lines").alias("pos", "line"))
        .select("path", "language", (F.col("pos") + 1).alias("line_no"), "line")
    )


def trim(col: Column) -> Column:
    # blanks go first: each character of an indent would else be sought among all that are white space
    return F.btrim(F.trim(col), F.lit(WHITESPACE))


def indent(col: Column) -> Column:
    return F.length(col) - F.length(F.ltrim(col, F.lit(WHITESPACE)))


def has_any(col: Column, literals: Iterable[str]) -> Column:
    """Substring tests, or-ed; cheaper than a regex alternation."""
    result = None
    for literal in literals:
        test = col.contains(literal)
        result = test if result is None else result | test
    return result


def starts_any(col: Column, prefixes: Iterable[str]) -> Column:
    result = None
    for prefix in prefixes:
        test = col.startswith(prefix)
        result = test if result is None else result | test
    return result


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, '' if there is none."""
    return F.regexp_extract(col, pattern, group)


def extract_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def count_of(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def brace_net(col: Column) -> Column:
    return count_of(col, "{") - count_of(col, "}")


def brace_low(col: Column) -> Column:
    """Lowest running brace balance inside the line, at most 0."""
    braces = F.split(F.regexp_replace(col, "[^{}]", ""), "")
    walked = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, b: F.struct(
            (acc["at"] + step(b)).alias("at"), F.least(acc["low"], acc["at"] + step(b)).alias("low")
        ),
        lambda acc: acc["low"],
    )
    return F.when(~col.contains("}"), F.lit(0)).otherwise(walked)


def step(brace: Column) -> Column:
    return F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)


def numbered(lines: Column, **extra) -> Column:
    """Array of structs (n, l, t, ...): 1-based number, raw line, trimmed line."""
    return F.transform(
        lines,
        lambda l, i: F.struct(
            (i + 1).alias("n"), l.alias("l"), trim(l).alias("t"), *[fn(l).alias(k) for k, fn in extra.items()]
        ),
    )


def scan(lines: Column, fn) -> Column:
    """Apply ``fn(line, line_no)`` to each line, keeping the non-null results."""
    return F.filter(F.transform(lines, lambda l, i: fn(l, i + 1)), lambda x: x.isNotNull())


def around(lines: Column, n: Column, before: int, after: int) -> Column:
    """Lines n-before .. n+after, cut at the file's ends (n is 1-based)."""
    start = F.greatest(n - before, F.lit(1))
    return F.slice(lines, start, n + after - start + 1)


def ahead(lines: Column, n: Column, count: int) -> Column:
    """The ``count`` lines after line n."""
    return F.slice(lines, n + 1, count)


def joined(lines: Column, sep: str = "\n") -> Column:
    return F.array_join(lines, sep)


def repeated(items: Column) -> Column:
    """Values that occur more than once in an array, by sort and neighbours."""
    ordered = F.array_sort(items)
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(items), F.lit(1))), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def struct_fold(events: Column, init: dict, step_fn, result: str) -> Column:
    """Ordered fold over an array of structs with a named-field accumulator.

    ``step_fn(acc, event)`` returns the next value per field; fields it leaves
    out keep their value.
    """
    names = list(init)

    def advance(acc, event):
        changed = step_fn(acc, event)
        return F.struct(*[(changed[k] if k in changed else acc[k]).alias(k) for k in names])

    start = F.struct(*[init[k].alias(k) for k in names])
    return F.aggregate(events, start, advance, lambda acc: acc[result])
