"""The whole review of rendered code, and its SQL out of the SQL of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelake import code_queries, memory_queries, pattern_queries
from sourcelake.code_queries import quoted
from sourcelake.operators import graphs, imports, naming, project, scan, security
from sourcelake.session import cut_lineage
from sourcelake.sources import derived

#: Categories and the query that finds for each.
PARTS = {
    "Architecture": "pattern_findings", "Memory & GC": "memory_findings", project.CIRCULAR: "cycle_findings", "Coupling": "coupling_findings",
    "Naming Conventions": "naming_findings", "Security": "code_security", "Dead Code": "dead_code", "Call Graph": "call_findings",
}


def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all parts; files are scanned once for the three that go by imports."""
    code = derived.code(spark, sf_dir)
    named = naming.naming_findings(code)
    described = pattern_queries.described(spark, sf_dir)
    edges, classes = scan.import_edges(described), described.select("path", "class_name")
    cycles = graphs.cycles(imports.import_graph(imports.resolved_imports(edges, classes)))
    parts = {
        "Architecture": pattern_queries.found(described), "Memory & GC": memory_queries.memory_findings(spark, sf_dir),
        project.CIRCULAR: graphs.cycle_findings(cycles), "Coupling": imports.coupling_findings(imports.code_coupling(edges, classes)),
        "Naming Conventions": named.withColumn("message", F.concat("kind", F.lit(" '"), "name", F.lit("' should be "), "expected")),
        "Security": security.security_findings(code), "Dead Code": code_queries.dead_code(spark, sf_dir), "Call Graph": code_queries.call_findings(spark, sf_dir),
    }
    return cut_lineage(project.gathered(parts))


def project_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.by_category(project_findings(spark, sf_dir), tuple(PARTS))


def project_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.fitness(project_findings(spark, sf_dir), derived.code(spark, sf_dir).select("path"))


def review_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first findings of each category, as the report shows them."""
    return project.shown(project_findings(spark, sf_dir))


QUERIES = {"project_review": project_review, "project_fitness": project_fitness, "review_examples": review_examples}


def oracles(known: dict[str, str]) -> dict[str, str]:
    """SQL of the review from ``known``, the SQL of its parts."""
    rule = {"pattern_findings": "rule", "cycle_findings": "rule_id", "coupling_findings": "rule_id", "call_findings": "rule_id", "naming_findings": "kind"}
    fixed = ("pattern_findings", "memory_findings", "dead_code")
    each = []
    for category, name in PARTS.items():
        message = "kind || ' ''' || name || ''' should be ' || expected" if name == "naming_findings" else "message"
        each.append(f"SELECT {quoted(category)} AS category, path, line_no::INTEGER AS line_no, {rule.get(name, 'type')} AS rule, severity, confidence, {message} AS message, {'fix' if name in fixed else 'NULL::VARCHAR'} AS fix FROM ({known[name]})")
    found = f"found AS MATERIALIZED ({' UNION ALL '.join(each)})"
    names = ", ".join(f"({quoted(c)})" for c in PARTS)
    circular = quoted(project.CIRCULAR)
    counts = "count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos"
    limits = project.BUDGET
    tests = " UNION ALL ".join(f"SELECT {quoted(n)} AS name, {what} {'>=' if what == 'health' else '<='} {limits[what]} AS passed, {what}::BIGINT AS value, {limits[what]}::BIGINT AS threshold, {quoted(told)} AS description FROM one" for n, what, told in project.TESTS)
    return {
        "project_review": f"""WITH {found}, c AS (SELECT n.category, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos
  FROM (VALUES {names}) n(category) LEFT JOIN found ON found.category = n.category GROUP BY n.category)
SELECT category, CASE WHEN errors > 0 OR category = {circular} AND errors + warnings + infos > 0 THEN 'FAIL' WHEN warnings > 3 THEN 'WARN' ELSE 'PASS' END AS verdict,
  greatest(0, 100 - CASE WHEN category = {circular} THEN (errors + warnings + infos) * {project.CYCLE_POINTS} ELSE 15 * errors + 5 * warnings + infos END)::BIGINT AS score, errors, warnings, infos, errors + warnings + infos AS violations FROM c""",
        "project_fitness": f"""WITH {found}, code AS ({derived.code_sql()}), a AS (SELECT {counts}, count(*) FILTER (category IN ({circular}, 'Coupling') AND contains(message, 'Circular')) AS cycles,
    count(*) FILTER (contains(lower(message), 'god class')) AS god_classes, count(*) FILTER (category IN ({circular}, 'Coupling') AND contains(message, 'imports')) AS coupling FROM found),
one AS (SELECT *, greatest(0, least(100, 100 - floor((5 * errors + 2 * warnings + infos) * 100 / greatest((SELECT count(*) FROM code) * 5, 1)))) AS health,
  (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM found GROUP BY path)) AS per_file FROM a)
{tests}""",
        "review_examples": f"""WITH {found} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, path, line_no, rule, message)::INTEGER AS place FROM found) WHERE place <= {project.SHOWN}""",
    }
