import json

from sourcelake.operators import drift, naming, thresholds
from sourcelake.sinks import reports
from sourcelake.streaming import debounce

FINDING = "path string, line_no int, type string, severity string, message string"


def test_naming(spark):
    rows = [("MyService.kt", "kotlin", "class MyService\nclass myService\nconst val max_x = 1\nval Bad_name = 2\n// class nope"), ("a.py", "python", "def process_data(x):\ndef processData(x):"), ("BadName.py", "python", None)]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    got = {(r["kind"], r["name"]) for r in naming.naming_findings(files).collect()}
    assert got == {("CLASS", "myService"), ("CONSTANT", "max_x"), ("VARIABLE", "Bad_name"), ("METHOD", "processData"), ("FILE", "BadName")}


def test_drift(spark):
    old = spark.createDataFrame([("a", 1, "X", "ERROR", "m"), ("b", 2, "X", "INFO", "m")], FINDING)
    new = spark.createDataFrame([("b", 2, "X", "INFO", "m"), ("c", 3, "Y", "WARNING", "m"), ("c", 3, "Y", "WARNING", "m")], FINDING)
    changes = drift.drift(old, new)
    assert {(r["fingerprint"], r["state"]) for r in changes.collect()} == {("X:a:1", "resolved"), ("Y:c:3", "new")}
    assert tuple(drift.drifting(changes, 80, 76).first()) == (1, 1, False)
    assert drift.drifting(changes, 80, 74).first()["drifting"]
    assert drift.drift(old.limit(0), old.limit(0)).collect() == []
    merged = drift.merge_incremental(old, spark.createDataFrame([("a",), ("a",)], "path string"), new.where("path = 'c'"))
    assert sorted(r["path"] for r in merged.collect()) == ["b", "c", "c"]


def test_limits(spark):
    rows = [("a", 3, "big", 21, 16, 51, 6), ("a", 90, "small", 10, 15, 50, 5), ("b", 1, "mid", 11, 0, 1, 0)]
    table = spark.createDataFrame(rows, "path string, start_line int, name string, cyclomatic int, cognitive int, line_count int, param_count int")
    got = {(r["name"], r["measure"], r["severity"]) for r in thresholds.over_limits(table).collect()}
    assert got == {("big", "cyclomatic", "ERROR"), ("big", "cognitive", "WARNING"), ("big", "line_count", "WARNING"), ("big", "param_count", "WARNING"), ("mid", "cyclomatic", "WARNING")}


def test_sarif(spark, tmp_path):
    table = spark.createDataFrame([("a.kt", 0, "WEAK_CRYPTO", "WARNING", 'said "x"'), ("b.kt", 7, "XSS", "INFO", "m")], FINDING)
    got = [json.loads(r["result"]) for r in reports.sarif_results(table).collect()]
    assert [(g["ruleId"], g["level"], g["message"]["text"]) for g in got] == [("security-weak-crypto", "warning", 'said "x"'), ("security-xss", "note", "m")]
    assert got[0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.kt"}, "region": {"startLine": 1}}
    reports.write_json(table, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_debounce_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:05:00"), (9, "2024-01-03 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = debounce.requests(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["user_id"], r["edits"]) for r in spark.table("bursts").collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}  # the last burst is still open
    assert {(r["user_id"], r["edits"]) for r in debounce.requests(events).collect()} == {(1, 2), (1, 1), (2, 1), (9, 1)}


def test_dead_code(spark):
    from sourcelake.operators import deadcode

    text = "fun a(): Int {\n    val used = 1\n    val lost = 2\n    val _kept = 3\n    return used\n\n    println(1)\n}\nprivate fun alone() {}\nif (false) { }\nwhile (true) { }\nreturn\n}"
    files = spark.createDataFrame([("a.kt", "kotlin", text), ("b.kt", "kotlin", None)], "path string, language string, text string")
    got = {(r["type"], r["name"], r["line_no"]) for r in deadcode.dead_code(files).collect()}
    assert got == {("UNUSED_VARIABLE", "lost", 3), ("UNREACHABLE_CODE", "println(1)", 7), ("UNUSED_PRIVATE_METHOD", "alone", 9), ("EMPTY_METHOD", "alone", 9), ("DEAD_CONDITIONAL", "if(false)", 10)}
