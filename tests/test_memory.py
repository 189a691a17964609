"""Memory rules on small files with known answers."""

from sourcelake.operators import memory

LEAKS = """val a = FileReader(x)
val b = new FileWriter(y)
b.close()
// val c = Socket(1)
try (val d = Scanner(f)) {
val e = Scanner(f)
}
val f = store.openConnection(q)
finally {
  a.close()
}
b = FileWriter(z)
x.use {
  val g = Socket(2)
}
"""
STATIC = """companion object {
    val grown = mutableListOf<Int>()
    val cut = HashMap<Int, Int>()
}
val free = mutableListOf<Int>()
fun f() { grown.add(1)
 cut.put(1, 2)
 cut.clear()
 free.add(1) }
private static final List<String> names = new ArrayList<>()
names.addAll(x)
"""
CACHES = "val userCache = HashMap<A, B>()\n" + "x\n" * 25 + "val pageCache: ConcurrentHashMap\nmaximumSize(3)\n"
LOOPS = """for (i in 0..3) {
    val s = StringBuilder(x)
    text += "a"
    val p = new Pair(1)
    val q = listOf(2)
    Point(1)
    Triple(1, 2, 3)
    word = word + "b"
    arrayOf(1)
}
other += "c"
items.forEach { make(new A()) }
"""
LISTEN = "button.addListener(x)\nbus.subscribe(y)\nbutton.addListener(z)\nbus.unsubscribe(y)\n"
OTHERS = "val t = ThreadLocal<Int>()\nprotected fun finalize() { }\n"


def found(spark, text, kind):
    files = spark.createDataFrame([("a.kt", "kotlin", text, 1), ("b.kt", "kotlin", None, 2), ("c.kt", "kotlin", "", 3)], "path string, language string, text string, line_no int")
    return sorted((r["line_no"], r["message"]) for r in memory.memory_findings(files).collect() if r["type"] == kind)


def names(rows):
    return [(n, message.split("'")[1]) for n, message in rows]


def test_resources(spark):
    assert names(found(spark, LEAKS, "RESOURCE_LEAK")) == [(8, "f"), (12, "b")]


def test_collections_and_caches(spark):
    assert names(found(spark, STATIC, "STATIC_COLLECTION_GROWTH")) == [(2, "grown"), (10, "names")]
    assert names(found(spark, CACHES, "UNBOUNDED_CACHE")) == [(1, "userCache")]


def test_loops(spark):
    assert [n for n, _ in found(spark, LOOPS, "STRING_CONCAT_IN_LOOP")] == [3, 8]
    assert found(spark, LOOPS, "ALLOCATION_IN_LOOP") == [(2, "Object allocation inside loop (started at line 1). Creates GC pressure — consider reusing or allocating outside the loop.")]
    assert found(spark, LOOPS, "GC_PRESSURE") == [(1, "Loop starting at line 1 creates ~5 allocations per iteration. This causes significant GC pressure and heap churn.")]


def test_listeners_and_others(spark):
    assert names(found(spark, LISTEN, "LISTENER_LEAK")) == [(3, "addListener")]
    assert found(spark, LISTEN + "class X : Disposable", "LISTENER_LEAK") == []
    assert [n for n, _ in found(spark, OTHERS, "THREAD_LOCAL_LEAK")] == [1] and [n for n, _ in found(spark, OTHERS, "FINALIZE_USAGE")] == [2]
    assert found(spark, OTHERS + "t.remove()", "THREAD_LOCAL_LEAK") == []


def test_nothing(spark):
    assert memory.memory_findings(spark.createDataFrame([], "path string, language string, text string")).collect() == []


def test_lines_are_held_in_columns(spark):
    files = spark.createDataFrame([("A.kt", "kotlin", "val a = 1\n" * 50)], "path string, language string, text string")
    plan = memory.memory_findings(files)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "parquet" in plan.lower()


def test_only_findings_are_written(spark):
    """One pass over the files: lines were written, read back and shuffled for each join before."""
    import os

    from sourcelake.session import shared_folder

    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    files = spark.createDataFrame([("a.kt", "kotlin", LEAKS), ("b.kt", "kotlin", LOOPS)], "path string, language string, text string").repartition(3, "path")
    rows = memory.memory_findings(files)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    new = [f for f in os.listdir(folder) if f not in before]
    assert len(new) == 1 and spark.read.parquet(f"{folder}/{new[0]}").count() == rows.count() > 5


def test_odd_files(spark):
    """A path that comes twice has its lines twice; without a path nothing is closed and no collection is added to."""
    schema = "path string, language string, text string"
    got = lambda rows: sorted((r["type"], r["line_no"]) for r in memory.memory_findings(spark.createDataFrame(rows, schema)).collect())
    text = "val a = FileReader(x)\na.close()\ncompanion val b = ArrayList()\nb.add(1)\nfor (i in x) {\n  s += \"x\"\n}"
    loop = ("STRING_CONCAT_IN_LOOP", 6)
    assert got([("a.kt", "kotlin", text)]) == [("STATIC_COLLECTION_GROWTH", 3), loop]
    assert got([("a.kt", "kotlin", text)] * 2) == [("STATIC_COLLECTION_GROWTH", 3), loop, loop]
    assert got([(None, "kotlin", text)]) == [("RESOURCE_LEAK", 1), loop]
    assert got([("a.kt", None, "　finally {\n\xa0x.close()\nx = Socket(1)")]) == [("RESOURCE_LEAK", 3)]
