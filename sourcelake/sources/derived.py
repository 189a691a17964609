"""A source-code corpus derived from the ``orders`` table.

The given tables hold no program text, so each order row is rendered into one
source file: a projection without a shuffle, growing with the table.  The
rendering is plain SQL text that Spark and other engines read alike.

In a template ``@k`` is the order key, ``@c`` the customer key, ``@x`` and
``@y`` small numbers made from both, ``@d``/``@e`` the directories of this
file and of the file it imports.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_DIRS = ("model", "controller", "service", "repository", "view", "util", "domain")

_JVM = [
    (None, ["package com.shop.@d", ""]),
    (None, ["import com.shop.@e.Order@c", "import com.shop.util.Order@x"]),
    ("k % 4 = 0", ["import java.util.Helper@y"]),
    ("k % 9 = 0", ["import com.shop.legacy.*", "import com.shop.Alias@y as Short@y"]),
    ("c % 3 = 0", ["import com.shop.@d.Order@y"]),
    ("k % 40 = 7", [f"import com.shop.bulk.Bulk{i}" for i in range(18)]),
    ("k % 80 = 27", [f"import com.shop.util.Order{i}" for i in range(1, 24) if i % 5]),
    ("k % 80 = 67", [f"import com.shop.util.Order{i}" for i in range(1, 44) if i % 5]),
    (None, [""]),
    ("k % 8 = 2", ["@RestController"]),
    ("k % 16 = 2", ["@PreAuthorize(admin)"]),
    ("k % 5 <> 0", ["class Order@k(val id: Int) : Base@y {"]),
    ("k % 5 = 0", ["interface order_@k {"]),
    (None, ["    private val total: Int = @x", "    var state@y = 0"]),
    ("k % 40 = 7", [f"    private val field{i}: Int = {i}" for i in range(16)]),
    ("k % 6 = 0", ["    val orderCache = HashMap<String, Int>()"]),
    ("k % 12 = 0", ["    // maximumSize is set by the loader"]),
    ("k % 7 = 0", ["    const val MAX_@x = 10", "    const val limit@x = 20"]),
    ("k % 10 = 3", ["    companion object {", "        val seen@y = mutableListOf<Int>()", "    }"]),
    ("k % 20 = 3", ["    fun forget() { seen@y.clear() }"]),
    ("k % 10 = 3", ["    fun note(v: Int) { seen@y.add(v) }"]),
    (None, [
        "",
        "    fun load@x(first: Int, second: Int, extra: String): Int {",
        "        val helper = Order@c(first)",
        "        if (first > second && second > 0) {",
        "            for (i in 0..first) {",
        "                if (i == second || i == @y) {",
        "                    return helper.size()",
        "                }",
        "            }",
        "        } else if (first == @x) {",
        "            return compute@y(first)",
        "        }",
        "        return compute@y(second)",
        "    }",
    ]),
    ("k % 3 = 0", [
        "",
        "    private fun compute@y(value: Int): Int {",
        "        val ratio = value / 2",
        "        while (value > ratio) {",
        "            val text = \"a\" + value",
        "            log.info(text)",
        "        }",
        "        return ratio",
        "        log.info(ratio)",
        "    }",
    ]),
    ("k % 6 = 1", [
        "",
        "    fun write@x(path: String) {",
        "        val out = FileWriter(path)",
        "        try {",
        "            out.write(path)",
        "        } catch (e: Exception) {",
        "        }",
        "    }",
    ]),
    ("k % 12 = 1", ["    fun finish() {", "        out.close()", "    }"]),
    ("k % 12 = 5", ["    fun copy(p: String) {", "        FileReader(p).use { r ->", "            val bad = FileReader(p)", "        }", "    }"]),
    ("k % 8 = 2", [
        "",
        "    @GetMapping(\"/orders\")",
        "    fun list@x(): List<Order> {",
        "        return repo.find(\"SELECT * FROM orders WHERE id = \" + id)",
        "    }",
        "    @PostMapping(\"/orders\")",
        "    fun create@x(order: Order@c) {",
        "        Runtime.getRuntime().exec(\"ls \" + order)",
        "    }",
    ]),
    ("k % 24 = 10", ["    fun safe() {", "        try { x() } finally { y() }", "    }"]),
    ("k % 11 = 4", [
        "    val password = \"hunter@x\"",
        "    val apiKey = \"changeme\"",
        "    val host = \"10.1.@y.7\"",
        "    val link = \"http://192.168.0.@y/index\"",
        "    // token = \"abcdef\"",
        "    val digest = MessageDigest.getInstance(\"MD5\")",
        "    val cipher = Cipher.getInstance(\"AES/ECB/PKCS5\")",
    ]),
    ("k % 13 = 6", [
        "    val rnd = new Random()",
        "    val factory = DocumentBuilderFactory.newInstance()",
        "    element.innerHTML = body",
        "    val stream = ObjectInputStream(input)",
        "    val file = new File(request.path)",
        "    response.sendRedirect(request.url)",
        "    logger.info(request.query)",
        "    println(password)",
    ]),
    ("k % 26 = 6", [
        "    factory.setFeature(XMLConstants.FEATURE_SECURE_PROCESSING, true)",
        "    val session = rnd.nextInt()",
    ]),
    ("k % 9 = 5", [
        "    val local@y = ThreadLocal<Int>()",
        "    fun work() {",
        "        synchronized(lock@y) {",
        "            synchronized(state@y) {",
        "                state@y += 1",
        "            }",
        "        }",
        "        Thread { run() }.start()",
        "        val pool = Executors.newCachedThreadPool()",
        "    }",
    ]),
    ("k % 18 = 5", ["    private val lock@y = Any()", "    fun drop() { local@y.remove() }"]),
    ("k % 15 = 8", [
        "    suspend fun pause@x() {",
        "        Thread.sleep(100)",
        "        if (map.containsKey(id)) {",
        "            map.put(id, 1)",
        "        }",
        "        if (file.exists()) {",
        "            file.delete()",
        "        }",
        "    }",
        "    fun get(): Any {",
        "        if (inst == null) {",
        "            synchronized(this) {",
        "                if (inst == null) {",
        "                    inst = Any()",
        "                }",
        "            }",
        "        }",
        "        return inst",
        "    }",
    ]),
    ("k % 14 = 9", [
        "    // val old = 1",
        "    // if (old > 0) {",
        "    //     return old;",
        "    // plain words",
        "    // old += 2;",
        "    fun total@x(items: List<Int>): Int {",
        "        var out = \"\"",
        "        for (item in items) {",
        "            out += \"x\"",
        "            val a = new Pair(1, 2)",
        "            val b = listOf(1)",
        "            val c = mapOf(1 to 2)",
        "            val d = ArrayList<Int>(items.sorted())",
        "            val e = new ArrayList()",
        "            val f = arrayOf(1)",
        "        }",
        "        button.addActionListener(this)",
        "        return total@x(items)",
        "    }",
    ]),
    ("k % 28 = 9", ["    fun dispose() { button.removeActionListener(this) }"]),
    ("k % 17 = 3", [
        "    fun deep@x(a: Int, b: Int, c: Int, d: Int, e: Int, f: Int): Int {",
        "        for (i in 0..a) {",
        "            for (j in 0..b) {",
        "                while (c > j) {",
        "                    if (a == 1 && b == 2 || c == 3) { d += 1 }",
        "                    if (a == 2 && b == 3 || c == 4) { d += 2 }",
        "                    if (a == 3 && b == 4 || c == 5) { d += 3 }",
        "                    else { break }",
        "                }",
        "            }",
        "        }",
        "        if (id != null) { return a }",
        "        if (total != null) { return b }",
        "        while (false) { }",
        "        return d",
        "    }",
        "    fun nothing() { }",
        "    protected fun finalize() { }",
        "    val shown: String = \"s\"",
        "    var maybe: String? = null",
        "    if (shown != null) { print(maybe) }",
        "    private fun solo@x(one: Int, vararg two: Int, _three: Int)",
        "    {",
        "    }",
        "    override fun told(four: Int) { }",
    ]),
    ("k % 30 = 13", [line for i in range(1, 12) for line in (f"    fun tier{i}(v: Int) {{", f"        tier{i + 1}(v)", "    }")]),
    ("k % 30 = 13", ["    fun tier12(v: Int) { }", "    fun tiers() {"] + [f"        tier{i}(1)" for i in range(1, 10)] + ["    }"]),
    ("k % 21 = 2", [
        "    fun chat@x() {",
    ] + [f"        Order@c.call{i}(id)" for i in range(12)] + ["    }"]),
    (None, ["}"]),
]

_PYTHON = [
    (None, ["import os, sys", "from shop.@e.Order@c import Order@c", "from abc import ABC", ""]),
    (None, ["class Order@k(ABC):", "    def __init__(self, name):", "        self.name = name", "        self.total@x = 0"]),
    (None, [
        "",
        "    def load_@x(self, first, second):",
        "        if first and second:",
        "            for item in first:",
        "                if item == @y:",
        "                    return self.compute@y(item)",
        "        elif second:",
        "            return Order@c(second)",
        "        return None",
        "",
        "    def compute@y(self, value):",
        "        # while this is a comment",
        "        return value",
    ]),
    ("k % 4 = 1", ["    def badName@x(self):", "        token = \"secret-@x\"", "        open(request.path)", "        return token"]),
]

_SCRIPT = [
    (None, ["import { Order@c } from \"./@e/Order@c\";", "const fs = require(\"fs\");"]),
    (None, [
        "class Order@k {",
        "  constructor(name) { this.name = name; }",
        "  async load@x(a, b) {",
        "    const item = new Order@c(a);",
        "    document.write(item);",
        "    return item.size(b);",
        "  }",
        "}",
        "function helper@y(a) {",
        "  return a || load@x(a, 1);",
        "}",
    ]),
    ("k % 5 = 1", ["const run = async (x) => helper@y(x);"]),
]

_KINDS = {"jvm": _JVM, "python": _PYTHON, "script": _SCRIPT}


def _render_line(line: str) -> str:
    parts = [p for p in re.split(r"(@[kcxyde])(?![A-Za-z])", line) if p]
    out = [p[1:] if re.fullmatch(r"@[kcxyde]", p) else "'" + p + "'" for p in parts]
    return " || ".join(out) if out else "''"


def _render(kind: str) -> str:
    pieces = []
    for condition, lines in _KINDS[kind]:
        body = " || chr(10) || ".join(_render_line(line) for line in lines) + " || chr(10)"
        pieces.append(f"({body})" if condition is None else f"CASE WHEN {condition} THEN {body} ELSE '' END")
    return "\n || ".join(pieces)


def _columns() -> tuple[str, str, str]:
    """What a file is made of: the numbers and names of an order, its path, its text."""
    dirs = "CASE {} % 7 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DIRS)) + " END"
    language = ("CASE k % 12 WHEN 4 THEN 'java' WHEN 5 THEN 'java' WHEN 7 THEN 'python' WHEN 8 THEN 'python' "
                "WHEN 11 THEN 'typescript' ELSE 'kotlin' END")
    suffix = "CASE language WHEN 'java' THEN '.java' WHEN 'python' THEN '.py' WHEN 'typescript' THEN '.ts' ELSE '.kt' END"
    facts = f"""CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c,
             (o_orderkey * 7 + o_custkey) % 50 AS x, (o_orderkey + o_custkey * 3) % 9 AS y,
             {dirs.format('o_orderkey')} AS d, {dirs.format('o_custkey')} AS e,
             {language.replace('k % 12', 'o_orderkey % 12')} AS language"""
    path = f"'src/' || d || '/' || CASE WHEN k % 5 = 0 THEN 'order_' ELSE 'Order' END || k || CASE WHEN k % 61 = 7 THEN 'Service' ELSE '' END || {suffix} AS path"
    text = f"""CASE language WHEN 'python' THEN {_render('python')}
                     WHEN 'typescript' THEN {_render('script')}
                     ELSE {_render('jvm')} END AS text"""
    return facts, path, text


def code_sql(orders: str = "orders") -> str:
    """SELECT path, language, text over an orders relation."""
    facts, path, text = _columns()
    return f"""
SELECT {path},
       language,
       {text}
FROM (SELECT {facts}
      FROM {orders}) AS src"""


#: Files of a partition, about 20 MB of text.
FILES = 8_000


def parts_for(spark: SparkSession, rows: DataFrame) -> int:
    """Partitions for a file of each row; the count is read from the tables' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILES))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, language, text): one rendered source file per order, partitioned by path.

    Orders are few bytes and may be one split, files are many: orders are dealt out
    by the path of their file before they are rendered.  What is grouped or ordered
    by path, lines included, then needs no further shuffle.
    """
    facts, path, text = _columns()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = parts_for(spark, orders)
    view = f"code_orders_{uuid.uuid4().hex}"  # a name of its own: callers don't overwrite each other's
    orders.createOrReplaceTempView(view)
    dealt = spark.sql(f"SELECT *, {path} FROM (SELECT {facts} FROM {view}) AS src").repartition(parts, "path")
    # the generator holds each text: the optimizer would put its long expression wherever the text is used
    return dealt.selectExpr("path", "language", text).select("path", "language", F.explode(F.array("text")).alias("text"))
