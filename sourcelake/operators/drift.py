"""Baselines, drift and incremental merges of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("type", "path", "line_no")


def fingerprint() -> Column:
    return F.concat_ws(":", *KEY)


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(fingerprint, severity, state): findings that are new or resolved against the baseline."""
    old = baseline.groupBy(fingerprint().alias("fingerprint")).agg(F.min("severity").alias("was"))
    new = current.groupBy(fingerprint().alias("fingerprint")).agg(F.min("severity").alias("now"))
    both = old.join(new, "fingerprint", "full").where("was is null or now is null")
    return both.select("fingerprint", F.coalesce("now", "was").alias("severity"), F.when(F.col("was").isNull(), "new").otherwise("resolved").alias("state"))


def drifting(changes: DataFrame, score_before: int, score_now: int) -> DataFrame:
    """One row: new and resolved findings, and whether the score fell by more than five or an error is new."""
    worse = score_now - score_before < -5
    return changes.agg(
        F.count_if(F.col("state") == "new").alias("new"), F.count_if(F.col("state") == "resolved").alias("resolved"),
        (F.lit(worse) | (F.count_if((F.col("state") == "new") & (F.col("severity") == "ERROR")) > 0)).alias("drifting"),
    )


def merge_incremental(known: DataFrame, changed_paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """Findings of changed files are replaced, others stay."""
    return known.join(changed_paths.select("path").distinct(), "path", "left_anti").unionByName(fresh)
