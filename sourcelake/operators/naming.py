"""Naming conventions: the name a line declares against the case its kind asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelake.functions import text as tx

# Cases, what declares a name, names that are let pass, languages.
PASCAL, CAMEL, UPPER, SNAKE = "^[A-Z][a-zA-Z0-9]*$", "^[a-z][a-zA-Z0-9]*$", "^[A-Z][A-Z0-9_]*$", "^[a-z][a-z0-9_]*$"
DECLARED = {
    "CLASS": r"(?:class|interface|enum|object|struct|trait)\s+([A-Za-z_]\w*)",
    "CONSTANT": r"(?:const\s+val|static\s+final|#define)\s+([A-Za-z_]\w*)",
    "VARIABLE": r"(?:val|var|let|const|final)\s+([a-zA-Z_]\w*)",
}
METHOD = r"(?:fun|(?:public|private|protected|static|override|suspend|final)\s+)+\s*(?:\w+\s+)?([a-zA-Z_]\w*)\s*\("
METHOD_OF = {"python": r"def\s+([a-zA-Z_]\w*)\s*\(", "go": r"func\s+(?:\([^)]*\)\s+)?([A-Za-z_]\w*)\s*\("}
NO_METHODS = ("if", "for", "while", "switch", "catch", "class", "main")
SNAKE_LANGUAGES = ("python", "ruby", "rust")
PASCAL_FILES, SNAKE_FILES = ("kotlin", "java", "csharp", "swift", "dart"), ("python", "ruby")
COMMENTS = ("//", "/*", "*", "#")


def _found(kind: str, name: Column, expected: Column, severity: str, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), expected.alias("expected"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))


def naming_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, name, expected, severity, confidence); narrow, in one pass over the files."""
    lang, t = F.col("language"), F.col("t")
    snake = lang.isin(*SNAKE_LANGUAGES)
    cased = F.when(snake, "snake_case").otherwise("camelCase")

    def name(pattern: str) -> Column:
        return F.nullif(tx.extract(t, pattern), F.lit(""))

    method = name(METHOD)
    for language, pattern in METHOD_OF.items():
        method = F.when(lang == language, name(pattern)).otherwise(method)
    # line 0 stands for the file: a table of its own would have the files made twice
    lines = tx.with_lines(files).select("path", "language", F.posexplode(F.concat(F.array(F.lit("")), "lines")).alias("line_no", "line"))
    lines = lines.withColumn("t", tx.trim(F.col("line"))).where(~tx.starts_any(F.col("t"), COMMENTS))
    named = lines.select(
        "path", "line_no", "language", name(DECLARED["CLASS"]).alias("class"), name(DECLARED["CONSTANT"]).alias("constant"),
        method.alias("method"), name(DECLARED["VARIABLE"]).alias("variable"),
    )

    def right(column: str) -> Column:
        return F.when(snake, F.col(column).rlike(SNAKE)).otherwise(F.col(column).rlike(CAMEL))

    c, k, m, v = (F.col(x) for x in ("class", "constant", "method", "variable"))
    hits = F.array(
        F.when(~c.rlike(PASCAL) & (c != "_"), _found("CLASS", c, F.lit("PascalCase"), "WARNING", 0.85)),
        F.when(~k.rlike(UPPER), _found("CONSTANT", k, F.lit("UPPER_SNAKE_CASE"), "WARNING", 0.85)),
        F.when(~m.isin(*NO_METHODS) & ~right("method") & ~m.startswith("_"), _found("METHOD", m, cased, "WARNING", 0.85)),
        F.when(k.isNull() & ~v.startswith("_") & ~right("variable") & ~v.rlike(UPPER), _found("VARIABLE", v, cased, "INFO", 0.7)),
    )
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    bad = (lang.isin(*PASCAL_FILES) & ~stem.rlike(PASCAL) & ~stem.contains("Test") & (stem != "build")) | (
        lang.isin(*SNAKE_FILES) & ~stem.rlike(SNAKE) & ~stem.isin("__init__", "__main__")
    )
    expected = F.when(lang.isin(*PASCAL_FILES), "PascalCase").otherwise("snake_case")
    of_file = F.when((F.col("line_no") == 0) & bad, _found("FILE", stem, expected, "INFO", 0.6))
    every = F.filter(F.concat(hits, F.array(of_file)), lambda h: h.isNotNull())
    rows = named.select("path", F.greatest("line_no", F.lit(1)).alias("line_no"), F.explode_outer(every).alias("h")).where("h is not null")
    return rows.select("path", "line_no", "h.*")
