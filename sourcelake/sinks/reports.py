"""Findings as JSON lines and SARIF results, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SARIF levels.
LEVELS = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """(result): one SARIF 2.1.0 result object for each finding, as JSON."""
    level = F.lit("note")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    place = F.struct(
        F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line_no"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")
    )
    rule = F.concat(F.lit("security-"), F.lower(F.replace(F.col("type"), F.lit("_"), F.lit("-"))))
    return findings.select(F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_json(findings: DataFrame, path: str) -> None:
    """JSON lines, one finding each."""
    findings.write.json(path)
