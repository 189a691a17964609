"""A whole review: findings of every analysis in one shape, rated by category, by file and against a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelake.operators import review

COLUMNS = ("category", "path", "line_no", "rule", "severity", "confidence", "message", "fix")
CIRCULAR = "Circular Dependencies"
# Points of a finding on a cycle, rows shown of a category, and what a project may have at most or at least.
CYCLE_POINTS, SHOWN = 20, 10
BUDGET = {"health": 60, "errors": 0, "warnings": 20, "cycles": 0, "god_classes": 0, "per_file": 10, "coupling": 3}
TESTS = (
    ("Minimum Health Score", "health", "Overall project health must meet minimum threshold"),
    ("Maximum Errors", "errors", "Architecture-breaking violations (ERROR severity)"),
    ("Warning Budget", "warnings", "Total warnings must stay within budget"),
    ("No Circular Dependencies", "cycles", "Circular import chains"),
    ("No God Classes", "god_classes", "Classes that are too large with too many responsibilities"),
    ("Max Violations Per File", "per_file", "No single file should accumulate too many violations"),
    ("High Coupling Files", "coupling", "Files with excessive import dependencies"),
)


def gathered(parts: dict[str, DataFrame]) -> DataFrame:
    """Findings of each category in one table; a table names its rule ``rule``, ``rule_id``, ``type`` or ``kind``, and may lack a fix."""
    out = None
    for category, rows in parts.items():
        rule = next(c for c in ("rule", "rule_id", "type", "kind") if c in rows.columns)
        fix = F.col("fix") if "fix" in rows.columns else F.lit(None).cast("string")
        part = rows.select(F.lit(category).alias("category"), "path", F.col("line_no").cast("int").alias("line_no"), F.col(rule).alias("rule"), "severity", "confidence", "message", fix.alias("fix"))
        out = part if out is None else out.unionByName(part)
    return out


def by_category(findings: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(category, verdict, score, errors, warnings, infos, violations) of every category, found or not.

    A cycle fails its category whatever its severity.
    """
    spark = findings.sparkSession
    counted = findings.groupBy("category").agg(*review.counts())
    rows = spark.createDataFrame([(n,) for n in names], "category string").join(counted, "category", "left")
    e, w, i = (F.coalesce(c, F.lit(0).cast("long")) for c in ("errors", "warnings", "infos"))
    rows = rows.select("category", e.alias("errors"), w.alias("warnings"), i.alias("infos"), (e + w + i).alias("violations"))
    lost = F.col("errors") * review.CATEGORY["ERROR"] + F.col("warnings") * review.CATEGORY["WARNING"] + F.col("infos") * review.CATEGORY["INFO"]
    lost = F.when(F.col("category") == CIRCULAR, F.col("violations") * CYCLE_POINTS).otherwise(lost)
    fails = (F.col("errors") > 0) | ((F.col("category") == CIRCULAR) & (F.col("violations") > 0))
    verdict = F.when(fails, "FAIL").when(F.col("warnings") > 3, "WARN").otherwise("PASS")
    return rows.select("category", verdict.alias("verdict"), F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"), "errors", "warnings", "infos", "violations")


def shown(findings: DataFrame, k: int = SHOWN) -> DataFrame:
    """The first ``k`` findings of each category, worst first, then by place; Spark keeps ``k`` of each before it shuffles."""
    worst = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    order = Window.partitionBy("category").orderBy(worst, "path", "line_no", "rule", "message")
    return findings.select("*", F.row_number().over(order).alias("place")).where(F.col("place") <= k)


def blockers(findings: DataFrame) -> DataFrame:
    """What must be mended: every error, as a line of text."""
    return findings.where("severity = 'ERROR'").select("category", F.concat("path", F.lit(":"), "line_no", F.lit(" — "), "rule", F.lit(": "), "message").alias("blocker"))


def fitness(findings: DataFrame, files: DataFrame, budget: dict[str, int] | None = None) -> DataFrame:
    """(name, passed, value, threshold, description) of seven tests against a budget; health is a least, all else a most."""
    limits = BUDGET | (budget or {})
    per_file = findings.groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("per_file"))  # one row each
    gate = review.gate(findings, files).select(F.col("score").cast("long").alias("health"), "errors", "warnings")
    coupling = F.col("category").isin(CIRCULAR, "Coupling")
    rest = findings.agg(
        F.count_if(coupling & F.col("message").contains("Circular")).alias("cycles"), F.count_if(F.lower("message").contains("god class")).alias("god_classes"),
        F.count_if(coupling & F.col("message").contains("imports")).alias("coupling"),
    )
    one = gate.crossJoin(rest).crossJoin(per_file)
    tests = [F.struct(F.lit(name).alias("name"), F.col(what).cast("long").alias("value"), F.lit(limits[what]).cast("long").alias("threshold"), F.lit(what == "health").alias("least"), F.lit(told).alias("description")) for name, what, told in TESTS]
    rows = one.select(F.explode(F.array(*tests)).alias("x")).select("x.*")
    passed = F.when(F.col("least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.select("name", passed.alias("passed"), "value", "threshold", "description")
