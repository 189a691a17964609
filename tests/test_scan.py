import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sourcelake.functions import text as tx
from sourcelake.operators import methods, scan
from sourcelake.sources import corpus, derived

KOTLIN = """package a
import com.x.Order
import com.y.Helper

class Main {
    fun run(first: Int, second: String): Int {
        // if this were code
        if (first > 1 && second != "if") {
            for (i in 0..first) {
                if (i == 2) { return i }
            }
        } else if (first == 3) {
            return Order(first).size()
        }
        return 0
    }
}
"""
PYTHON = "import os\nfrom a.b import c\n\nclass Thing:\n    def calculate(self, x, y):\n        if x:\n            return y\n        return 1\n"


@pytest.fixture
def files(spark):
    rows = [("src/Main.kt", "kotlin", KOTLIN), ("b.py", "python", PYTHON), ("empty.py", "python", ""), ("null.py", "python", None)]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_scan_facts(files):
    got = {r["path"]: r for r in scan.scan_files(files).collect()}
    main = got["src/Main.kt"]
    assert main["class_name"] == "Main" and main["line_count"] == 17 and main["concrete_deps"] == ["Order"]
    assert [i["target"] for i in main["imports"]] == ["com.x.Order", "com.y.Helper"]
    assert got["b.py"]["method_count"] == 1 and got["b.py"]["class_name"] == "Thing"
    assert got["empty.py"]["line_count"] == 0 and got["null.py"]["line_count"] == 0


def test_import_edges(files):
    got = sorted((r["path"], r["target"], r["line_no"]) for r in scan.import_edges(scan.scan_files(files)).collect())
    assert got == [("b.py", "a.b", 2), ("b.py", "os", 1), ("src/Main.kt", "com.x.Order", 2), ("src/Main.kt", "com.y.Helper", 3)]


@pytest.mark.parametrize(
    "language, line, target",
    [
        ("java", "import static com.example.Foo.bar;", "com.example.Foo.bar"),
        ("csharp", "using var stream = Open();", None),
        ("typescript", "import { a } from './b';", "./b"),
        ("javascript", "const a = require('fs');", "fs"),
        ("go", '"net/http"', "net/http"),
        ("ruby", "require_relative 'lib/x'", "lib/x"),
        ("rust", "use std::io;", "std::io"),
        ("php", "use App\\Models\\User as U;", "App\\Models\\User"),
        ("unknown", "import x", None),
    ],
)
def test_import_line(spark, language, line, target):
    df = spark.createDataFrame([(language, line)], "language string, line string")
    assert df.select(scan.import_target(df["line"], df["language"]).alias("t")).first()["t"] == target


def test_methods(files):
    got = {r["name"]: r for r in methods.method_table(files).collect()}
    run, calculate = got["run"], got["calculate"]
    assert (run["start_line"], run["end_line"], run["param_count"]) == (6, 16, 2)
    assert run["cyclomatic"] >= 4 and run["cognitive"] >= 4
    assert (calculate["param_count"], calculate["start_line"], calculate["end_line"]) == (2, 5, 8)


def test_method_plan_holds_line_scores_once(files):
    plan = methods.method_table(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\"]*+") <= 3


def test_long_line_with_one_apostrophe(spark):
    files = spark.createDataFrame([("a.js", "javascript", "can't " + "x" * 1_000_000)], "path string, language string, text string")
    assert methods.file_complexity(files).first()["cyclomatic"] == 1


def test_comments_do_not_count(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", "// if (a) for (b)\n# while\n* if\n")], "path string, language string, text string")
    assert methods.file_complexity(files).first()["cyclomatic"] == 1


def test_masked_strings(spark):
    df = spark.createDataFrame([("a \"if\" b",), ("don't if",), ('x "a\\"if" y',), ("plain",)], "line string")
    got = [r[0] for r in df.select(methods.mask_strings(df["line"])).collect()]
    assert got == ['a "" b', 'don""', 'x "" y', "plain"]


@pytest.mark.parametrize("folder", ["tree", "build"])
def test_read_tree_keeps_hidden_names(spark, tmp_path, folder, monkeypatch):
    root = tmp_path / folder
    for name in ("a.py", "__init__.py", "_app.ts", "sub/.x.py", "node_modules/lib.js", "sub/build/Out.kt", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    want = {"a.py": "python", "__init__.py": "python", "_app.ts": "typescript", "sub/.x.py": "python"}
    monkeypatch.chdir(tmp_path)
    for at in (str(root), f"file://{root}", folder):
        assert {r["path"]: r["language"] for r in corpus.read_tree(spark, at).collect()} == want


def test_lines(spark):
    files = spark.createDataFrame([("a", "x", "one\r\ntwo\n\n"), ("b", "x", ""), ("c", "x", None)], "path string, language string, text string")
    assert [(r["line_no"], r["line"]) for r in tx.explode_lines(files).collect()] == [(1, "one"), (2, "two"), (3, "")]


def test_rendered_code_is_dealt_out_by_path(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    files = derived.code(spark, sf)
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # orders are one split
    monkeypatch.setattr(derived, "FILES", 100)
    assert derived.code(spark, sf).rdd.getNumPartitions() == 15
    plain = spark.read.parquet(f"{sf}/orders.parquet")
    plain.createOrReplaceTempView("plain_orders")
    want = spark.sql(derived.code_sql("plain_orders"))
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, want.collect()))
    ordered = tx.explode_lines(files).select(F.row_number().over(Window.partitionBy("path").orderBy("line_no")))
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_lines_split_at_every_terminator(spark):
    texts = {"": [], "\n": [""], "a\n": ["a"], "a\n\n": ["a", ""], "a\r\nb\rc\n": ["a", "b", "c"], "a\nb": ["a", "b"], "ä\n\r": ["ä", ""]}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["l"] for r in df.select("text", tx.split_lines(df["text"]).alias("l")).collect()} == texts


def test_lines_are_trimmed_once(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", "class A {\n}")], "path string, language string, text string")
    plan = scan.scan_files(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(lines") == 1


def test_methods_in_one_pass(spark):
    """Lines are scored in one function, not in expressions over arrays; odd files keep their rows."""
    rows = [
        ("a.kt", "kotlin", "fun open(a: Int) {\nfun shut(b, c) {\n  if (x && y) { for (i in z) { } }\n  else { try { } }\n}\nval s = \"if (\"\nfun last() = 1"),
        ("a.kt", "kotlin", "fun again(this, d) { }"), ("b.py", "python", "def f(self, a):\n  while a:\n    pass\n\ndef g():\n  # if\n  return 'if'"),
        (None, None, "void m(int x) {\r\n} "), ("c.kt", "kotlin", None), ("d.kt", "kotlin", ""),
    ]
    found = methods.method_table(spark.createDataFrame(rows, "path string, language string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    got = sorted((r["path"] or "", r["name"], r["start_line"], r["end_line"], r["param_count"], r["cyclomatic"], r["cognitive"]) for r in found.collect())
    assert got == [
        ("", "m", 1, 2, 1, 1, 0), ("a.kt", "again", 1, 1, 1, 1, 0), ("a.kt", "last", 7, 7, 0, 1, 0), ("a.kt", "open", 1, 2, 1, 1, 0), ("b.py", "f", 1, 4, 1, 2, 1), ("b.py", "g", 5, 7, 0, 1, 0),
    ]
