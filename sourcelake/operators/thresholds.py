"""Limits on the methods table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits; a cyclomatic complexity over ERROR_OVER is an error.
LIMITS = {"cyclomatic": 10, "cognitive": 15, "line_count": 50, "param_count": 5}
ERROR_OVER = 20


def over_limits(methods: DataFrame) -> DataFrame:
    """(path, line_no, name, measure, value, severity) of each limit a method exceeds; narrow."""
    found = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value"), F.lit(limit).alias("most")) for m, limit in LIMITS.items()])
    rows = methods.select("path", F.col("start_line").alias("line_no"), "name", F.explode(found).alias("x")).where("x.value > x.most")
    error = (F.col("x.measure") == "cyclomatic") & (F.col("x.value") > ERROR_OVER)
    return rows.select("path", "line_no", "name", "x.measure", "x.value", F.when(error, "ERROR").otherwise("WARNING").alias("severity"))
