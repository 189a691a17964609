"""Ten kinds of dead code, on small files with known answers."""

from sourcelake.operators import deadcode

IMPORTS = """import a.b.Used
import a.b.Lost
import a.b.Long as Short
import a.b.*
import x.Semi;
import odd thing
import b.Later
val one = Used() + Short() + "odd thing"
// Semi in words
"""
METHODS = """abstract fun none(a: Int)
fun first(used: Int, lost: Int, _mine: Int, vararg many: Int): Int {
    if (used > 1) { log(many) }
    return 1
}
override fun told(other: Int) { }
fun expression(z: Int) = 1
fun wide(
fun brace(q: String)

{
}
fun deep(p: Int) { { p } }
fun open(r: Int) {
"""
CATCHES = """fun run() {
    try {
        go()
    } catch (e: Exception) {
    }
    try { go() } catch (e: Exception) { log(e) }
    try { go() } catch (e: Exception) { /* why */ }
    catch (e: X) {   }
}
"""
PRIVATE = """private fun f() { }
private fun used() { 1 }
private fun generic() { 1 }
private suspend inline fun alone() { alone() }
private fun named() { 1 }
val a = used() + this.generic<Int>()
fun named() { 1 }
"""
COMMENTS = """// val a = 1
// if (a > 0) {
// words
// more words
code
// one
// two = 2;
// three
// four words
x
// return a
// return b
// return c
// return d
// return e"""
NULLS = """val name: String = "a"
val maybe: String? = null
var plain: Order
if (name != null) { }
if (maybe != null) { }
if ( plain != null ) { }
if (other != null) { }
"""


def found(spark, text, *kinds):
    files = spark.createDataFrame([("a.kt", "kotlin", text, 1), ("b.kt", "kotlin", None, 2), ("c.kt", "kotlin", "", 3)], "path string, language string, text string, line_no int")
    return {(r["type"], r["line_no"], r["name"]) for r in deadcode.dead_code(files).collect() if not kinds or r["type"] in kinds}


def test_imports(spark):
    got = found(spark, IMPORTS, "UNUSED_IMPORT")
    assert got == {("UNUSED_IMPORT", 2, "a.b.Lost"), ("UNUSED_IMPORT", 7, "b.Later")}


def test_methods(spark):
    got = found(spark, METHODS, "UNUSED_PARAMETER", "EMPTY_METHOD")
    # the bodiless method takes the next block within four lines; a block that is never closed has no body
    assert got == {("UNUSED_PARAMETER", 1, "a"), ("UNUSED_PARAMETER", 2, "lost"), ("UNUSED_PARAMETER", 9, "q"), ("EMPTY_METHOD", 6, "told"), ("EMPTY_METHOD", 9, "brace")}


def test_catches_and_private_methods(spark):
    assert found(spark, CATCHES, "EMPTY_CATCH") == {("EMPTY_CATCH", 4, "catch"), ("EMPTY_CATCH", 8, "catch")}
    got = found(spark, PRIVATE, "UNUSED_PRIVATE_METHOD", "EMPTY_METHOD")
    assert got == {("UNUSED_PRIVATE_METHOD", 1, "f"), ("EMPTY_METHOD", 1, "f"), ("UNUSED_PRIVATE_METHOD", 4, "alone"), ("UNUSED_PRIVATE_METHOD", 5, "named")}


def test_comments_and_nulls(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", COMMENTS)], "path string, language string, text string")
    rows = deadcode.dead_code(files).where("type = 'COMMENTED_CODE'").collect()
    assert sorted((r["line_no"], r["confidence"], r["message"][:13]) for r in rows) == [(1, 0.5, "4 consecutive"), (11, 0.9, "5 consecutive")]
    assert found(spark, NULLS, "REDUNDANT_NULL_CHECK") == {("REDUNDANT_NULL_CHECK", 4, "name"), ("REDUNDANT_NULL_CHECK", 6, "plain")}


def test_texts(spark):
    files = spark.createDataFrame([("a.kt", "kotlin", "fun a(lost: Int) {\n  return 1\n  b()\n}")], "path string, language string, text string")
    got = {r["type"]: (r["message"], r["fix"]) for r in deadcode.dead_code(files).collect()}
    assert got == {
        "UNUSED_PARAMETER": ("Parameter 'lost' in method 'a' is never used in the method body.", "Remove unused parameter 'lost' or prefix with '_' if required by interface."),
        "UNREACHABLE_CODE": ("Code after 'return 1' is unreachable.", "Remove unreachable code after the terminating statement."),
    }


def test_nothing(spark):
    assert deadcode.dead_code(spark.createDataFrame([], "path string, language string, text string")).collect() == []


def test_no_line_is_written_or_shuffled(spark):
    """One pass over the files: what the old joins shuffled and wrote, a row a line and a row a word, outgrew the disk."""
    import os

    from sourcelake.session import shared_folder

    folder = shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    files = spark.createDataFrame([("a.kt", "kotlin", METHODS), ("b.kt", "kotlin", CATCHES)], "path string, language string, text string").repartition(3, "path")
    rows = deadcode.dead_code(files)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert len(rows.collect()) > 5
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_odd_files(spark):
    """A path that comes twice has its lines twice; without a path no name is found again; words and blanks beyond ASCII."""
    schema = "path string, language string, text string"
    once = [("a.kt", "kotlin", "val alone = 1\nreturn\nval next = 2")]
    got = lambda rows: sorted((r["type"], r["line_no"], r["name"]) for r in deadcode.dead_code(spark.createDataFrame(rows, schema)).collect())
    dead = ("UNREACHABLE_CODE", 3, "val next = 2")
    assert got(once) == [dead, ("UNUSED_VARIABLE", 1, "alone"), ("UNUSED_VARIABLE", 3, "next")]
    assert got(once + once) == [("UNREACHABLE_CODE", 2, "return"), dead]  # each name is on two lines
    text = "import a.Used\nprivate fun f() { }\nf() + Used()"
    assert got([("b.kt", "kotlin", text)]) == [("EMPTY_METHOD", 2, "f")]
    assert got([(None, "kotlin", text)]) == [("UNUSED_IMPORT", 1, "a.Used"), ("UNUSED_PRIVATE_METHOD", 2, "f")]
    assert got([("c.kt", None, "private fun f() { \xa0 }\néf()\n　return\n　x")]) == [("EMPTY_METHOD", 1, "f"), ("UNREACHABLE_CODE", 4, "x"), ("UNUSED_PRIVATE_METHOD", 1, "f")]
