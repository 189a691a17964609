"""Registered queries over the given tables, and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelake import code_queries, memory_queries, pattern_queries, project_queries
from sourcelake.functions import text as tx
from sourcelake.operators import drift, duplicates, graphs, methods, naming, review, scan, security, thresholds
from sourcelake.sinks import reports
from sourcelake.session import written
from sourcelake.sources import corpus, derived


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and turns as files(path, language, text), partitioned by path.

    A table may be one row group, which one task reads: its texts are dealt out
    before they are split into lines and searched.
    """
    files = corpus.documents(spark, sf_dir).unionByName(corpus.pages(spark, sf_dir)).unionByName(corpus.conversations(spark, sf_dir))
    return files.repartition(derived.parts_for(spark, files), "path")


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tx.explode_lines(texts(spark, sf_dir))
    length = F.length("line")
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(tx.trim(F.col("line")) == "").alias("blank_lines"),
        F.max(length).cast("long").alias("longest"), F.sum(length).alias("chars"),
    )


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tx.with_lines(texts(spark, sf_dir)).select("language", F.size("lines").cast("long").alias("line_count"))
    return review.language_histogram(files)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.security_findings(texts(spark, sf_dir))


def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir)


def code_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen types over rendered code, which has each of them."""
    return security.security_findings(derived.code(spark, sf_dir))


def security_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.crosstab(findings(spark, sf_dir))


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.gate(findings(spark, sf_dir), texts(spark, sf_dir))


def review_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.categories(findings(spark, sf_dir))


def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.top_files(findings(spark, sf_dir))


def sure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.at_least(findings(spark, sf_dir), "ERROR", 0.9)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges between modules: the brand of a part depends on its supplier's nation, and this on its region."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    both = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    return both.select(F.col("p_brand").alias("src"), F.concat(F.lit("nation"), "s_nationkey").alias("dst"))


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.coupling(trade(spark, sf_dir))


def layer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers' nations to suppliers' nations, by region."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    edges = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("src", "dst")
    layers = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("module"), F.col("n_regionkey").alias("layer"))
    return graphs.layer_edges(edges, layers)


def duplicate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six equal lines (trimmed) that occur more than once: one row each, whatever the number of places."""
    lines = tx.explode_lines(corpus.documents(spark, sf_dir)).select("path", "line_no", tx.trim(F.col("line")).alias("line"))
    ahead = Window.partitionBy("path").orderBy("line_no").rowsBetween(0, 5)
    windows = lines.select("path", "line_no", F.collect_list("line").over(ahead).alias("six")).where(F.size("six") == 6)
    windows = windows.where(F.exists("six", lambda x: x != "")).withColumn("hash", F.md5(F.array_join("six", "\n")))
    found = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("path").alias("files"), F.min("path").alias("first_file"))
    return found.where("places > 1")


def duplicate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six lines that are equal once comments, literals and names are out, in rendered code and documents."""
    return duplicates.duplicate_code(derived.code(spark, sf_dir).unionByName(corpus.documents(spark, sf_dir)))


def code_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Repeated windows of rendered code and documents, and those files."""
    files = derived.code(spark, sf_dir).unionByName(corpus.documents(spark, sf_dir))
    return duplicates.repeated(written(duplicates.windows(files), "windows")), files


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_blocks(code_windows(spark, sf_dir)[0])


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_lines(*code_windows(spark, sf_dir))


def duplicate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.block_findings(duplicate_blocks(spark, sf_dir))


def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced bursts: events of a user less than thirty minutes apart are one analysis, at the last of them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    mine = Window.partitionBy("user_id").orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    flagged = events.withColumn("starts", F.when(at - F.lag(at).over(mine) < 1_800_000_000, 0).otherwise(1))
    numbered = flagged.withColumn("burst", F.sum("starts").over(mine.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("edits"), F.max("ts").alias("analysed_at"))


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of files rendered from orders: imports, classes, methods."""
    scanned = scan.scan_files(derived.code(spark, sf_dir))
    return scanned.select("path", "language", "class_name", "method_count", "line_count", "is_interface", F.size("imports").alias("n_imports"))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.import_edges(scan.scan_files(derived.code(spark, sf_dir)))


def code_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods.method_table(derived.code(spark, sf_dir))


def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods.file_complexity(texts(spark, sf_dir))



def naming_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_findings(derived.code(spark, sf_dir))


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents and pages as the baseline, of documents and turns as the current state."""
    docs = corpus.documents(spark, sf_dir)
    before = security.security_findings(docs.unionByName(corpus.pages(spark, sf_dir)))
    now = security.security_findings(docs.unionByName(corpus.conversations(spark, sf_dir)))
    return drift.drift(before, now)


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(findings(spark, sf_dir))


def code_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.over_limits(code_methods(spark, sf_dir))


QUERIES = {
    "scan_lines": scan_lines,
    "language_histogram": language_histogram,
    "security_findings": security_findings,
    "code_security": code_security,
    "security_crosstab": security_crosstab,
    "review_gate": review_gate,
    "review_categories": review_categories,
    "top_files": top_files,
    "sure_errors": sure_errors,
    "coupling": coupling,
    "layer_graph": layer_graph,
    "duplicate_windows": duplicate_windows,
    "duplicate_code": duplicate_code,
    "duplicate_blocks": duplicate_blocks,
    "duplicate_lines": duplicate_lines,
    "duplicate_findings": duplicate_findings,
    "edit_sessions": edit_sessions,
    "code_scan": code_scan,
    "code_imports": code_imports,
    "code_methods": code_methods,
    "code_limits": code_limits,
    "text_complexity": text_complexity,
    "naming_findings": naming_findings,
    "drift_report": drift_report,
    "sarif_results": sarif_results,
    **code_queries.QUERIES,
    **pattern_queries.QUERIES,
    **memory_queries.QUERIES,
    **project_queries.QUERIES,
}

# -- the same in SQL ---------------------------------------------------------

_RAW = r"""
raw AS (
  SELECT 'doc_' || doc_id AS path, lang AS language, text FROM documents
  UNION ALL SELECT 'page_' || page_id, 'javascript', replace(html, '>', '>' || chr(10)) FROM pages
  UNION ALL SELECT 'conv_' || conv_id || '_' || turn, role, text FROM conversations
), """
_LINES = r"""files AS (
  SELECT path, language, CASE WHEN coalesce(text, '') = '' THEN []
    ELSE string_split_regex(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') END AS lines FROM raw
), lines AS (
  SELECT path, unnest(generate_series(1, len(lines))) AS line_no, unnest(lines) AS line FROM files
), trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(160)) AS t FROM lines)
"""
_FILES = _RAW + _LINES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(pattern: str) -> str:
    return f"regexp_matches(line, {_quoted(pattern)})"


def _rule_sql(rule: security.Rule) -> str:
    """A line rule without look-around, which this SQL has not."""
    tests = []
    for pattern, message in rule.patterns:
        plain = pattern.replace("(?!.*sanitize)", "")
        test = _matches(plain)
        if plain != pattern:
            test += " AND NOT " + _matches(plain + ".*sanitize")
        tests.append(f"WHEN {test} THEN {_quoted(message)}")
    sure = str(rule.confidence)
    if rule.surer[0]:
        sure = f"CASE WHEN {_matches(rule.surer[0])} THEN {rule.surer[1]} ELSE {sure} END"
    if rule.type == "HARDCODED_SECRET":
        marks = [f"contains(lower(path), {_quoted(m)})" for m in security.TEST_MARKS] + [f"ends_with(lower(path), {_quoted(m)})" for m in security.TEST_ENDS]
        sure = f"CASE WHEN {' OR '.join(marks)} THEN 0.4 ELSE {sure} END"
    if rule.type == "SQL_INJECTION":
        sure = f"CASE WHEN message = {_quoted(rule.patterns[-1][1])} THEN {security.WEAK_SQL} ELSE {sure} END"
    where = ["true"]
    if rule.guard:
        where.append(_matches(rule.guard))
    if rule.unless:
        where.append("NOT " + _matches(rule.unless))
    if rule.code_only:
        where.append("NOT (t LIKE '//%' OR t LIKE '*%' OR t LIKE '#%')")
    return (
        f"SELECT path, line_no, '{rule.type}' AS type, '{rule.cwe}' AS cwe, '{rule.severity}' AS severity, "
        f"({sure})::DOUBLE AS confidence, message FROM (SELECT *, CASE {' '.join(tests)} END AS message FROM trimmed WHERE {' AND '.join(where)}) WHERE message IS NOT NULL"
    )


_IP_SQL = r"""
SELECT path, line_no, 'HARDCODED_IP' AS type, 'CWE-1051' AS cwe, 'WARNING' AS severity,
  CASE WHEN url THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence,
  CASE WHEN url THEN 'Hardcoded URL with IP address ''' ELSE 'Hardcoded IP address ''' END || ip || ''' detected.' AS message
FROM (
  SELECT *, list_filter(regexp_extract_all(line, '(?:^|[^.\d])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:[^.\d]|$)', 1),
      lambda x: x NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255', '1.0.0.0') AND NOT starts_with(x, '0.'))[1] AS ip,
    regexp_matches(line, 'https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') AS url
  FROM trimmed WHERE NOT (t LIKE '//%' OR t LIKE '*%' OR t LIKE '#%')
) WHERE ip IS NOT NULL
"""
_RANDOM_SQL = f"""
SELECT path, line_no, 'INSECURE_RANDOM' AS type, 'CWE-330' AS cwe, CASE WHEN near THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN near THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN near THEN 'java.util.Random used in a security-sensitive context. It is not cryptographically secure.'
    ELSE 'java.util.Random detected. If used for security purposes, replace with SecureRandom.' END AS message
FROM (SELECT path, line_no, line, bool_or(regexp_matches(line, {_quoted(security.RANDOM_CONTEXT)})) OVER
    (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lines)
WHERE {_matches(security.RANDOM)}
"""
_AUTH_SQL = f"""
SELECT path, line_no, 'MISSING_AUTH' AS type, 'CWE-306' AS cwe, 'WARNING' AS severity, 0.7::DOUBLE AS confidence,
  'Endpoint mapping without authentication annotation. Ensure this endpoint is intentionally public.' AS message
FROM (SELECT path, line_no, line, bool_or({_matches(security.CONTROLLER)}) OVER p AS controller, bool_or(starts_with(t, '@') AND {_matches(security.AUTH)} AND NOT {_matches(security.ENDPOINT)}) OVER p AS guarded,
    coalesce(bool_or({_matches(security.AUTH)}) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS near FROM trimmed WINDOW p AS (PARTITION BY path))
WHERE controller AND NOT guarded AND NOT near AND {_matches(security.ENDPOINT)}
"""
_XXE_SQL = f"""
SELECT path, line_no, 'XXE' AS type, 'CWE-611' AS cwe, 'ERROR' AS severity, 0.7::DOUBLE AS confidence,
  'XML parser factory created without disabling external entities. This may allow XXE attacks.' AS message
FROM (SELECT path, line_no, line, coalesce(bool_or({_matches(security.XML_SAFE)}) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), false) AS safe FROM lines)
WHERE NOT safe AND {_matches(security.XML_FACTORY)}
"""
_FINDINGS = "findings AS (" + "\nUNION ALL ".join([_rule_sql(r) for r in security.RULES] + [_IP_SQL, _RANDOM_SQL, _AUTH_SQL, _XXE_SQL]) + ")"
_WITH = f"WITH {_FILES}, {_FINDINGS}"
_COUNTS = "count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos"



def _naming_sql() -> str:
    def name(pattern: str) -> str:
        return f"nullif(regexp_extract(t, {_quoted(pattern)}, 1), '')"

    method = "CASE language " + " ".join(f"WHEN '{k}' THEN {name(p)}" for k, p in naming.METHOD_OF.items()) + f" ELSE {name(naming.METHOD)} END"
    right = "regexp_matches({0}, CASE WHEN snake THEN '" + naming.SNAKE + "' ELSE '" + naming.CAMEL + "' END)"
    cased = "CASE WHEN snake THEN 'snake_case' ELSE 'camelCase' END"
    listed = lambda xs: ", ".join(map(_quoted, xs))
    return rf"""
WITH code AS ({derived.code_sql()}),
l AS (SELECT path, language, unnest(generate_series(1, len(s))) AS line_no, unnest(s) AS line FROM
  (SELECT path, language, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS s FROM code)),
t AS (SELECT *, trim(line, ' ' || chr(9)) AS t, language IN ({listed(naming.SNAKE_LANGUAGES)}) AS snake FROM l),
n AS (SELECT path, line_no, snake, {name(naming.DECLARED["CLASS"])} AS c, {name(naming.DECLARED["CONSTANT"])} AS k, {method} AS m, {name(naming.DECLARED["VARIABLE"])} AS v
  FROM t WHERE NOT ({" OR ".join(f"starts_with(t, '{x}')" for x in naming.COMMENTS)})),
f AS (SELECT path, language, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM code)
SELECT path, line_no::INTEGER AS line_no, 'CLASS' AS kind, c AS name, 'PascalCase' AS expected, 'WARNING' AS severity, 0.85::DOUBLE AS confidence FROM n WHERE NOT regexp_matches(c, '{naming.PASCAL}') AND c <> '_'
UNION ALL SELECT path, line_no, 'CONSTANT', k, 'UPPER_SNAKE_CASE', 'WARNING', 0.85 FROM n WHERE NOT regexp_matches(k, '{naming.UPPER}')
UNION ALL SELECT path, line_no, 'METHOD', m, {cased}, 'WARNING', 0.85 FROM n WHERE m NOT IN ({listed(naming.NO_METHODS)}) AND NOT {right.format("m")} AND NOT starts_with(m, '_')
UNION ALL SELECT path, line_no, 'VARIABLE', v, {cased}, 'INFO', 0.7 FROM n WHERE k IS NULL AND NOT starts_with(v, '_') AND NOT {right.format("v")} AND NOT regexp_matches(v, '{naming.UPPER}')
UNION ALL SELECT path, 1, 'FILE', stem, CASE WHEN language IN ({listed(naming.PASCAL_FILES)}) THEN 'PascalCase' ELSE 'snake_case' END, 'INFO', 0.6 FROM f
WHERE (language IN ({listed(naming.PASCAL_FILES)}) AND NOT regexp_matches(stem, '{naming.PASCAL}') AND NOT contains(stem, 'Test') AND stem <> 'build')
   OR (language IN ({listed(naming.SNAKE_FILES)}) AND NOT regexp_matches(stem, '{naming.SNAKE}') AND stem NOT IN ('__init__', '__main__'))
"""


ORACLES = {
    **code_queries.ORACLES,
    **pattern_queries.ORACLES,
    **memory_queries.ORACLES,
    "naming_findings": _naming_sql(),
    "drift_report": f"""{_WITH}, f AS (SELECT type || ':' || path || ':' || line_no AS fingerprint, min(severity) AS severity, any_value(path) AS path FROM findings GROUP BY 1)
SELECT fingerprint, severity, CASE WHEN path LIKE 'page%' THEN 'resolved' ELSE 'new' END AS state FROM f WHERE path NOT LIKE 'doc%'""",
    "scan_lines": f"""WITH {_FILES}
SELECT path, count(*) AS n_lines, count(*) FILTER (t = '') AS blank_lines, max(length(line))::BIGINT AS longest, sum(length(line))::BIGINT AS chars
FROM trimmed GROUP BY path""",
    "language_histogram": f"""WITH {_FILES}
SELECT language, count(*) AS files, sum(len(lines))::BIGINT AS lines, round(count(*) * 100 / (SELECT count(*) FROM files), 2) AS percent FROM files GROUP BY language""",
    "security_findings": f"{_WITH} SELECT path, line_no::INTEGER AS line_no, type, cwe, severity, confidence, message FROM findings",
    "code_security": f"WITH raw AS ({derived.code_sql()}), {_LINES}, {_FINDINGS} SELECT path, line_no::INTEGER AS line_no, type, cwe, severity, confidence, message FROM findings",
    "sure_errors": f"{_WITH} SELECT path, line_no::INTEGER AS line_no, type, cwe, severity, confidence, message FROM findings WHERE severity = 'ERROR' AND confidence >= 0.9",
    "security_crosstab": f"""{_WITH}
SELECT CASE WHEN grouping(type) = 1 THEN 'TOTAL' ELSE type END AS type, count(*) FILTER (severity = 'ERROR') AS error,
  count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info, count(*) AS total
FROM findings GROUP BY ROLLUP (type)""",
    "review_categories": f"""{_WITH}, c AS (SELECT type AS category, {_COUNTS} FROM findings GROUP BY type)
SELECT category, errors, warnings, infos, greatest(0, 100 - 15 * errors - 5 * warnings - infos)::BIGINT AS score,
  CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 3 THEN 'WARN' ELSE 'PASS' END AS verdict FROM c""",
    "review_gate": f"""{_WITH}, c AS (SELECT {_COUNTS}, count(*) AS violations FROM findings), n AS (SELECT count(*) AS files FROM files),
s AS (SELECT *, greatest(0, least(100, 100 - floor((5 * errors + 2 * warnings + infos) * 100 / greatest(files * 5, 1))))::INTEGER AS score FROM c, n)
SELECT files, violations, errors, warnings, infos, score, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 5 THEN 'WARN'
  WHEN score < 60 THEN 'FAIL' WHEN score < 80 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s""",
    "top_files": f"{_WITH} SELECT path, count(*) AS findings FROM findings GROUP BY path ORDER BY findings DESC, path LIMIT 10",
    "coupling": """WITH e AS (SELECT DISTINCT p_brand AS src, 'nation' || s_nationkey AS dst FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT src AS module, 0 AS ca, 1 AS ce FROM e WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM e WHERE src <> dst)
SELECT module, sum(ca)::BIGINT AS ca, sum(ce)::BIGINT AS ce, sum(ce)::DOUBLE / sum(ca + ce) AS instability FROM m GROUP BY module""",
    "layer_graph": """SELECT a.n_regionkey AS src_layer, b.n_regionkey AS dst_layer, count(*) AS edges
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL""",
    "duplicate_windows": f"""WITH {_FILES}, w AS (
  SELECT path, list(t) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS six FROM trimmed WHERE path LIKE 'doc_%'),
h AS (SELECT path, md5(array_to_string(six, chr(10))) AS hash FROM w WHERE len(six) = 6 AND len(list_filter(six, lambda x: x <> '')) > 0)
SELECT hash, count(*) AS places, count(DISTINCT path) AS files, min(path) AS first_file FROM h GROUP BY hash HAVING count(*) > 1""",
    "edit_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS starts FROM events),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, burst::BIGINT AS burst, count(*) AS edits, max(ts) AS analysed_at FROM b GROUP BY ALL""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_categories(spark, sf_dir)
ORACLES |= project_queries.oracles(ORACLES)
