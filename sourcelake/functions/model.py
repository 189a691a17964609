"""The finding record every analyzer emits, and helpers to build it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities and categories.
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
SEVERITY_ORDER = {INFO: 0, WARNING: 1, ERROR: 2}

CATEGORIES = (
    "ARCHITECTURE", "NAMING", "COMPLEXITY", "SOLID", "CODE_SMELL", "COUPLING",
    "ORGANIZATION", "MEMORY", "THREAD_SAFETY", "SECURITY", "DEAD_CODE", "DUPLICATION",
)

_FIELDS = (
    ("rule_id", "string"),
    ("rule_name", "string"),
    ("pattern_name", "string"),
    ("category", "string"),
    ("severity", "string"),
    ("line_no", "int"),
    ("message", "string"),
    ("suggested_fix", "string"),
    ("confidence", "double"),
)
ISSUE_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS) + ">"
ISSUES_TYPE = f"array<{ISSUE_TYPE}>"
FINDING_COLUMNS = ["path"] + [n for n, _ in _FIELDS]


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def issue(**values) -> Column:
    """One finding as a struct column; fields in the order of ``_FIELDS``."""
    defaults = {"suggested_fix": None, "confidence": 1.0, "category": "ARCHITECTURE", "rule_id": ""}
    merged = {**defaults, **values}
    return F.struct(*[as_col(merged[n]).cast(t).alias(n) for n, t in _FIELDS])


def no_issues() -> Column:
    return F.array().cast(ISSUES_TYPE)


def keep(array: Column) -> Column:
    """Drop the nulls a ``when`` without ``otherwise`` leaves in an array."""
    return F.filter(array, lambda x: x.isNotNull())


def guarded(guard: Column, issues: Column) -> Column:
    """Evaluate ``issues`` only for files whose whole text passes ``guard``."""
    return F.when(guard, issues).otherwise(no_issues())


def merge(*parts: Column) -> Column:
    return F.concat(*parts)


def severity_order(col: Column) -> Column:
    return F.when(col == ERROR, 2).when(col == WARNING, 1).otherwise(0)


def findings(files: DataFrame, issues: Column) -> DataFrame:
    """Explode a per-file issue array into finding rows (narrow, no shuffle)."""
    return files.select("path", F.inline_outer(issues)).where(F.col("severity").isNotNull()).select(*FINDING_COLUMNS)
