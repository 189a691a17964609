import pytest

from sourcelake.operators import graphs, review, security

SNIPPETS = {
    "SQL_INJECTION": 'String q = "SELECT * FROM users WHERE id = " + id;',
    "XSS": "el.innerHTML = value;",
    "HARDCODED_SECRET": 'String password = "super_secret_123";',
    "PATH_TRAVERSAL": 'new File(request.getParameter("f"))',
    "COMMAND_INJECTION": 'Runtime.getRuntime().exec("ls " + cmd);',
    "INSECURE_DESERIALIZATION": "new ObjectInputStream(in)",
    "WEAK_CRYPTO": 'MessageDigest.getInstance("MD5")',
    "HARDCODED_IP": 'connect("10.1.2.3")',
    "OPEN_REDIRECT": "sendRedirect(request.url)",
    "LOG_INJECTION": "log.info(request.body)",
    "SENSITIVE_DATA_EXPOSURE": "logger.info(user.password)",
    "INSECURE_RANDOM": "val token = new Random()",
    "XXE": "DocumentBuilderFactory.newInstance()",
    "MISSING_AUTH": '@RestController\nclass A {\n  @GetMapping("/x")\n  fun x() {}\n}',
}
CLEAN = (
    'String password = "changeme";', 'String password = "";', "// password = \"hidden_value\"", 'connect("127.0.0.1")',
    "version 1.2.3.4.5", 'ps = c.prepareStatement("SELECT a FROM b WHERE c = ?", 1); ps.setString(1, a + b);',
)


def files(spark, rows):
    return spark.createDataFrame([(f"f{i}.java", "java", t) for i, t in enumerate(rows)], "path string, language string, text string")


@pytest.fixture(scope="module")
def found(spark):
    return security.security_findings(files(spark, SNIPPETS.values())).collect()


@pytest.mark.parametrize("n, kind", list(enumerate(SNIPPETS)))
def test_type(found, n, kind):
    assert kind in {r["type"] for r in found if r["path"] == f"f{n}.java"}


def test_clean(spark):
    assert security.security_findings(files(spark, CLEAN)).collect() == []


def test_guards(spark):
    safe = 'XMLInputFactory.newInstance()\nf.setFeature("disallow-doctype-decl", true)'
    guarded = "@RestController\n@PreAuthorize(admin)\n@GetMapping\nfun x()"
    assert security.security_findings(files(spark, [safe, guarded, None, ""])).collect() == []


def test_crosstab_and_scores(spark, found):
    table = spark.createDataFrame(found)
    rows = {r["type"]: r for r in security.crosstab(table).collect()}
    assert rows["TOTAL"]["total"] == len(found) == sum(r["total"] for k, r in rows.items() if k != "TOTAL")
    gate = review.gate(table, files(spark, SNIPPETS.values())).first()
    assert gate["verdict"] == "FAIL" and gate["errors"] == sum(r["severity"] == "ERROR" for r in found)


@pytest.mark.parametrize(
    "errors, warnings, files_, score, verdict",
    [(0, 0, 10, 100, "PASS"), (0, 0, 0, 100, "PASS"), (100, 0, 5, 0, "FAIL"), (0, 6, 100, 98, "WARN"), (0, 5, 4, 50, "FAIL"), (0, 5, 9, 78, "WARN")],
)
def test_gate(spark, errors, warnings, files_, score, verdict):
    rows = [("t", "ERROR")] * errors + [("t", "WARNING")] * warnings
    got = review.gate(spark.createDataFrame(rows, "type string, severity string"), spark.range(files_)).first()
    assert (got["score"], got["verdict"]) == (score, verdict)


def test_graphs(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("d", "d")], "src string, dst string")
    got = {r["module"]: (r["ca"], r["ce"]) for r in graphs.coupling(edges).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "c": (1, 2), "d": (1, 0), "x": (0, 1)}


def test_long_lines(spark):
    """A line of a million characters takes no longer than its length asks for."""
    import time

    n = 500_000
    lines = ['select ' + '"' * n, "password = \"abcdef\" " + "<" * n, "select + " + '"' * n, "{" * n + ' token = "abcdef"', "exec(" * (n // 5), '"select ' * (n // 8)]
    files = spark.createDataFrame([(str(i), "kotlin", x) for i, x in enumerate(lines)], "path string, language string, text string")
    security.security_findings(files.where("path = 'none'")).collect()
    began = time.time()
    got = {(r["path"], r["type"]) for r in security.security_findings(files).collect()}
    assert got == {("1", "HARDCODED_SECRET"), ("2", "SQL_INJECTION"), ("3", "HARDCODED_SECRET")} and time.time() - began < 20


def test_placeholders(spark):
    """Secrets beside something in braces or angles are examples."""
    kept = ['password = "hunter22"', 'password = "a<b"', 'password = "a<>b"', 'password = "{}x"']
    dropped = ['password = "<secret>"', 'password = "{value}"', 'password = "<x<>"', 'password = "<<>"', 'password = "{a{}"']
    files = spark.createDataFrame([(x, "kotlin", x) for x in kept + dropped], "path string, language string, text string")
    assert {r["path"] for r in security.security_findings(files).collect()} == set(kept)


def test_texts_are_dealt_out(spark, tmp_path):
    """Tables of one row group each: their texts go to all cores, and each is there once."""
    from sourcelake import registry

    rows = range(40)
    spark.createDataFrame([(i, f"open\n{i}", "en") for i in rows], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "<p>a</p>") for i in rows], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0, "user", None) for i in rows], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    texts = registry.texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    kept = texts.collect()
    assert len({r["path"] for r in kept}) == len(kept) == 120 and sum(r["text"] is None for r in kept) == 40
    placed = {r[0] for r in texts.selectExpr("spark_partition_id()").collect()}
    assert len(placed) == texts.rdd.getNumPartitions()


def test_texts_without_a_trigger_are_not_split(spark):
    """Rules on lines around find what they found, in texts and in lines."""
    rows = ["val a = new  Random()", "java.util.Random", "SAXParserFactory . newInstance ( )", '@Controller\n@RequestMapping("/")', "Random words", None]
    want = {("f0.java", "INSECURE_RANDOM"), ("f1.java", "INSECURE_RANDOM"), ("f2.java", "XXE"), ("f3.java", "MISSING_AUTH")}
    df = files(spark, rows)
    assert {(r["path"], r["type"]) for r in security.context_findings(df).collect()} == want
    lines = df.selectExpr("path", "language", "coalesce(split(text, '\\n'), array()) as lines")
    assert {(r["path"], r["type"]) for r in security.context_findings(lines).collect()} == want
