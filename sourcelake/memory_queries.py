"""The memory rules over rendered code, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelake.code_queries import CODE, extract, quoted
from sourcelake.operators import memory
from sourcelake.sources import derived


def memory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.memory_findings(derived.code(spark, sf_dir))


QUERIES = {"memory_findings": memory_findings}

# -- the same in SQL ---------------------------------------------------------


def _has(column: str, texts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(x)})" for x in texts) + ")"


def _matches(pattern: str) -> str:
    return f"regexp_matches(t, {quoted(pattern)})"


def _on(on: str, off: str) -> str:
    return f"({on} OR coalesce(last_value(CASE WHEN {on} THEN 1 WHEN {off} THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1)"


def _issue(kind: str, source: str, name: str = "''", line_no: str = "line_no") -> str:
    severity, sure, told, fix = memory.KINDS[kind]
    parts = [f"({name})" if p == "%" else line_no if p == "@" else quoted(p) for p in told.replace("%", "\0%\0").replace("@", "\0@\0").split("\0") if p]
    return f"SELECT path, {line_no}::INTEGER AS line_no, '{kind}' AS type, '{severity}' AS severity, {sure}::DOUBLE AS confidence, {' || '.join(parts)} AS message, {quoted(fix)} AS fix FROM {source}"


def _loops(segment: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, sum(net) OVER (PARTITION BY path, {segment} ORDER BY line_no) AS inside FROM g WHERE {segment} > 0),
{name}1 AS (SELECT *, coalesce(bool_or(inside <= 0) OVER (PARTITION BY path, {segment} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM {name}0),
{name} AS MATERIALIZED (SELECT * FROM {name}1 WHERE NOT ended)"""


_MARKS = " UNION ALL ".join(
    f"SELECT path, {quoted(a)} AS mark, max(CASE WHEN contains(t, {quoted(a)}) THEN line_no END) AS line_no, bool_or(contains(line, {quoted(r)})) AS gone FROM g WHERE NOT cleans GROUP BY path" for a, r in memory.REMOVED.items()
)
_STATIC = f"[{extract(memory.STATIC)}, CASE WHEN {extract(memory.STATIC)} = '' AND static THEN {extract(memory.IN_STATIC)} ELSE '' END, {extract(memory.JAVA_STATIC)}]"
_GROWS, _SHRINKS = ("(" + " OR ".join(f"contains(t, name || {quoted(x)})" for x in texts) + ")" for texts in (memory.GROWS, memory.SHRINKS))
_MAKES = f"({_has('t', memory.MAKES)} OR ({_matches(memory.CALLS)} AND regexp_matches(t, '^[A-Z]')))"
_ORDER = "(PARTITION BY path ORDER BY line_no)"

MEMORY_SQL = f"""
WITH {CODE},
g0 AS (SELECT path, line_no, line, t, (len(t) - len(replace(t, '{{', ''))) - (len(t) - len(replace(t, '}}', ''))) AS net, starts_with(t, '//') OR starts_with(t, '*') OR starts_with(t, '/*') AS comment,
  {_matches(memory.ANY_LOOP)} OR {_has("t", (".forEach", ".map {", ".flatMap", ".filter {"))} AS any_loop, {_matches(memory.PLAIN_LOOP)} OR contains(t, '.forEach') AS loop,
  {_matches(memory.PLAIN_LOOP)} OR {_has("t", (".forEach", ".map {"))} AS map_loop FROM t),
g1 AS (SELECT *, sum(net) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {memory.STATIC_BEHIND} PRECEDING AND CURRENT ROW) AS recent, sum(any_loop::INTEGER + net) OVER {_ORDER} AS total FROM g0),
g2 AS (SELECT *, total - least(min(total) OVER {_ORDER}, 0) AS after, {_on(f"(NOT comment AND {_has('t', memory.GUARDED)})", "NOT comment AND t = '}'")} AS guarded,
  {_on(_has("t", memory.STATIC_MARKS), "t = '}' AND line_no > 1 AND recent <= 0")} AS static,
  bool_or({_has("line", memory.EVICTION)}) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {memory.CACHE_BEHIND} PRECEDING AND {memory.CACHE_AHEAD} FOLLOWING) AS evicts,
  bool_or(contains(line, '.remove()')) OVER (PARTITION BY path) AS removes, bool_or({_has("line", memory.CLEANUP)}) OVER (PARTITION BY path) AS cleans,
  sum(loop::INTEGER) OVER {_ORDER} AS segment, sum(map_loop::INTEGER) OVER {_ORDER} AS map_segment FROM g1),
g3 AS (SELECT *, coalesce(lag(after) OVER {_ORDER}, 0) AS depth FROM g2),
g AS MATERIALIZED (SELECT *, last_value(CASE WHEN any_loop AND depth = 0 THEN line_no END IGNORE NULLS) OVER {_ORDER} AS began FROM g3),
o AS (SELECT path, line_no, unnest(list_concat(regexp_extract_all(t, {quoted(memory.OPENED[0])}, 1), regexp_extract_all(t, {quoted(memory.OPENED[1])}, 1))) AS name FROM g WHERE NOT comment AND NOT guarded),
cl AS (SELECT path, line_no AS pos, {extract(memory.CLOSED)} AS name, t = '}}' AS stop FROM g),
fi AS (SELECT g.path, g.line_no, pos, name, coalesce(bool_or(stop) OVER (PARTITION BY g.path, g.line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past
  FROM g JOIN cl ON cl.path = g.path AND pos > g.line_no AND pos <= g.line_no + {memory.FINALLY_AHEAD} WHERE starts_with(t, 'finally') AND NOT comment AND NOT guarded),
closed AS (SELECT path, name, max(line_no) AS closed_at FROM (SELECT path, name, line_no FROM fi WHERE NOT past AND name <> '' UNION ALL
  SELECT path, {extract(memory.CLOSED)} AS name, line_no FROM g WHERE NOT comment AND NOT guarded) GROUP BY path, name),
opened AS (SELECT path, name, max(line_no) AS line_no FROM o GROUP BY path, name),
sm AS (SELECT path, name, min(line_no) AS since, max(line_no) AS line_no FROM (SELECT path, line_no, unnest({_STATIC}) AS name FROM g) WHERE name <> '' GROUP BY path, name),
sg AS (SELECT sm.path, name, sm.line_no, bool_or({_GROWS}) AS grows, bool_or({_SHRINKS}) AS shrinks FROM sm JOIN g ON g.path = sm.path AND g.line_no >= since GROUP BY sm.path, name, sm.line_no),
{_loops("segment", "s")}, {_loops("map_segment", "m")},
heavy AS (SELECT path, min(line_no) AS line_no, count(*) FILTER ({_MAKES}) AS made, min(inside) AS low FROM m GROUP BY path, map_segment),
marks AS ({_MARKS})
{_issue("RESOURCE_LEAK", "opened LEFT JOIN closed USING (path, name) WHERE closed_at IS NULL OR closed_at < line_no", "name")}
UNION ALL {_issue("STATIC_COLLECTION_GROWTH", "sg WHERE grows AND NOT shrinks", "name")}
UNION ALL {_issue("UNBOUNDED_CACHE", f"g WHERE {extract(memory.CACHE)} <> '' AND NOT evicts", extract(memory.CACHE))}
UNION ALL {_issue("ALLOCATION_IN_LOOP", f"g WHERE depth + any_loop::INTEGER > 0 AND {_matches(memory.ALLOCATED)}", "coalesce(began, 0)")}
UNION ALL {_issue("STRING_CONCAT_IN_LOOP", f"s WHERE {_matches(memory.CONCATENATED)}")}
UNION ALL {_issue("LISTENER_LEAK", "marks WHERE line_no IS NOT NULL AND NOT gone", "mark")}
UNION ALL {_issue("GC_PRESSURE", f"heavy WHERE made >= {memory.MANY_MADE} AND low <= 0", "made")}
UNION ALL {_issue("THREAD_LOCAL_LEAK", "g WHERE (contains(line, 'new ThreadLocal') OR contains(line, 'ThreadLocal<')) AND NOT removes")}
UNION ALL {_issue("FINALIZE_USAGE", f"g WHERE {_matches(memory.FINALIZE)}")}
"""

ORACLES = {"memory_findings": MEMORY_SQL}
