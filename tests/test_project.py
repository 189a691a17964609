"""The whole review over small tables of findings."""

from sourcelake.operators import project

ROWS = [
    ("Security", "a", 1, "SQL", "ERROR", 0.9, "bad", "mend"), ("Security", "a", 2, "IP", "WARNING", 0.7, "worse", None), ("Dead Code", "b", 1, "X", "INFO", 0.9, "God Class here", None),
    (project.CIRCULAR, "c", 1, "circular-dep", "WARNING", 0.95, "Circular dependency detected: c -> d -> c", None), ("Coupling", "c", 1, "cli-coupling", "WARNING", 0.9, "File has 16 outgoing imports", None),
]
SCHEMA = "category string, path string, line_no int, rule string, severity string, confidence double, message string, fix string"


def test_categories(spark):
    found = spark.createDataFrame(ROWS + [("Naming", f"n{i}", 1, "r", "WARNING", 0.5, "m", None) for i in range(4)], SCHEMA)
    got = {r["category"]: (r["verdict"], r["score"], r["violations"]) for r in project.by_category(found, ("Security", "Dead Code", project.CIRCULAR, "Coupling", "Naming", "Memory")).collect()}
    assert got == {"Security": ("FAIL", 80, 2), "Dead Code": ("PASS", 99, 1), project.CIRCULAR: ("FAIL", 80, 1), "Coupling": ("PASS", 95, 1), "Naming": ("WARN", 80, 4), "Memory": ("PASS", 100, 0)}
    assert [tuple(r) for r in project.blockers(found).collect()] == [("Security", "a:1 — SQL: bad")]


def test_shown(spark):
    found = spark.createDataFrame([("Naming", f"n{i:02}", 1, "r", "ERROR" if i == 29 else "INFO", 0.5, "m", None) for i in range(30)] + ROWS, SCHEMA)
    rows = sorted((r["place"], r["path"]) for r in project.shown(found, 3).where("category = 'Naming'").collect())
    assert rows == [(1, "n29"), (2, "n00"), (3, "n01")]


def test_fitness(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["name"]: (r["passed"], r["value"]) for r in project.fitness(found, spark.range(3)).collect()}
    assert got == {
        "Minimum Health Score": (False, 20), "Maximum Errors": (False, 1), "Warning Budget": (True, 3), "No Circular Dependencies": (False, 1), "No God Classes": (False, 1),
        "Max Violations Per File": (True, 2), "High Coupling Files": (True, 1),
    }
    assert all(r["passed"] for r in project.fitness(found, spark.range(3), {"health": 0, "errors": 9, "cycles": 9, "god_classes": 1}).collect())
    none = {r["name"]: (r["passed"], r["value"]) for r in project.fitness(found.limit(0), spark.range(0)).collect()}
    assert none["Minimum Health Score"] == (True, 100) and none["Max Violations Per File"] == (True, 0)


def test_gathered(spark):
    typed = spark.createDataFrame([("a", 1, "T", "INFO", 0.5, "m")], "path string, line_no long, type string, severity string, confidence double, message string")
    ruled = spark.createDataFrame([("b", 2, "R", "INFO", 0.5, "m", "f")], "path string, line_no int, rule_id string, severity string, confidence double, message string, fix string")
    rows = {tuple(r) for r in project.gathered({"A": typed, "B": ruled}).collect()}
    assert rows == {("A", "a", 1, "T", "INFO", 0.5, "m", None), ("B", "b", 2, "R", "INFO", 0.5, "m", "f")}


def test_files_are_scanned_once(spark, tmp_path, monkeypatch):
    """Patterns, cycles and coupling read one scan of the files, and find what they find alone."""
    from sourcelake import code_queries, memory_queries, pattern_queries, project_queries
    from sourcelake.operators import scan

    spark.createDataFrame([(k, k % 7) for k in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    alone = {"Architecture": pattern_queries.pattern_findings, project.CIRCULAR: code_queries.cycle_findings, "Coupling": code_queries.coupling_findings}
    want = {c: f(spark, str(tmp_path)).count() for c, f in alone.items()}
    none = spark.createDataFrame([], "path string, line_no int, type string, severity string, confidence double, message string")
    for module, name in ((memory_queries, "memory_findings"), (code_queries, "dead_code"), (code_queries, "call_findings")):
        monkeypatch.setattr(module, name, lambda *_: none)
    scans, real = [], scan.scan_files
    monkeypatch.setattr(scan, "scan_files", lambda files: scans.append(1) or real(files))
    found = project_queries.project_findings(spark, str(tmp_path))
    got = {r["category"]: r["count"] for r in found.groupBy("category").count().collect()}
    assert len(scans) == 1 and {c: got.get(c, 0) for c in want} == want and sum(want.values()) > 0


def test_trim(spark):
    """Blanks between other white space go as well."""
    from pyspark.sql import functions as F

    from sourcelake.functions import text as tx

    rows = ["", " ", " \t 　 a b \x1c ", "\t a", "a \xa0 ", None, "  x  "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(tx.trim(F.col("t"))).collect()] == [t if t is None else t.strip(tx.WHITESPACE) for t in rows]
