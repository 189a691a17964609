"""Queries of architecture patterns over rendered code, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelake.code_queries import CODE, IMPORTS, quoted
from sourcelake.operators import methods, patterns, scan
from sourcelake.session import cut_lineage, written
from sourcelake.sources import derived
from sourcelake.sources.patterns import Layer, Pattern, Rule, built_in

#: Kinds of rules over files whose facts SQL can tell.
SQL_RULES = ("LAYER_DEPENDENCY", "NAMING_CONVENTION", "FILE_ORGANIZATION", "SINGLE_RESPONSIBILITY", "INTERFACE_SEGREGATION", "COUPLING")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the rendered files, written by column: each rule of each pattern reads only what it is about."""
    scanned = scan.scan_files(derived.code(spark, sf_dir))
    return written(scanned.select("path", "class_name", "imports", "method_count", "line_count", "is_interface", "concrete_deps"), "described")


def found(files: DataFrame) -> DataFrame:
    """All twelve patterns' rules on layers, names, folders, sizes and imports."""
    return patterns.file_findings(files, built_in(), SQL_RULES)


def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(described(spark, sf_dir))


def inversion_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.file_findings(described(spark, sf_dir), built_in(), ("DEPENDENCY_INVERSION",))


def method_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.method_findings(cut_lineage(methods.method_table(derived.code(spark, sf_dir))), built_in())


def file_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.classified(derived.code(spark, sf_dir).select("path"), built_in())


QUERIES = {
    "pattern_findings": pattern_findings,
    "inversion_findings": inversion_findings,
    "method_findings": method_findings,
    "file_layers": file_layers,
}

# -- the same in SQL ---------------------------------------------------------


def _layer(layers: tuple[Layer, ...]) -> str:
    cases = [f"WHEN {' OR '.join(f'contains(path, {quoted(g[2:-2])})' for g in x.globs)} THEN {quoted(x.name)}" for x in layers]
    return f"CASE {' '.join(cases)} END"


def _import_layer(layers: tuple[Layer, ...]) -> str:
    words = {x.name: sorted({w for g in x.globs for w in g[3:-3].split("/")}) for x in layers}
    return f"CASE {' '.join(f'WHEN list_has_any(segments, {w}) THEN {quoted(n)}' for n, w in words.items())} END"


def _named(layer: Layer) -> str:
    return "(" + " OR ".join(f"regexp_full_match(name, {quoted(x)})" for x in layer.names) + ")"


def _text(template: str) -> str:
    """SQL for a text with columns at ``{name}``."""
    pieces = template.replace("{", "\0{").replace("}", "}\0").split("\0")
    return " || ".join(p[1:-1] if p.startswith("{") else quoted(p) for p in pieces if p)


def _rows(p: Pattern, r: Rule, source: str, message: str, fix: str, severity: str | None = None, line_no: str = "1", sure: float = 1.0) -> str:
    return (
        f"SELECT path, {line_no}::INTEGER AS line_no, {quoted(p.name)} AS pattern, {quoted(r.id)} AS rule_id, {quoted(r.name)} AS rule, {quoted(severity or r.severity)} AS severity, "
        f"{sure}::DOUBLE AS confidence, {message} AS message, {fix} AS fix FROM {source}"
    )


def _rule(p: Pattern, r: Rule) -> str:
    if r.type == "LAYER_DEPENDENCY":
        allowed = " OR ".join(f"layer = {quoted(x.name)} AND other IN ({', '.join(map(quoted, x.allowed))})" for x in p.layers if x.allowed)
        source = f"(SELECT *, {_layer(p.layers)} AS layer, {_import_layer(p.layers)} AS other FROM targets) WHERE layer <> other AND NOT ({allowed})"
        message = _text("Layer '{layer}' should not depend on '{other}'. Import '{target}' violates dependency direction.")
        return _rows(p, r, source, message, quoted("Move this dependency behind an abstraction or restructure to respect layer boundaries."), line_no="line_no")
    if r.type == "NAMING_CONVENTION":
        layers = [x for x in p.layers if x.names]
        bad = " OR ".join(f"layer = {quoted(x.name)} AND NOT {_named(x)}" for x in layers)
        source = f"(SELECT *, {_layer(p.layers)} AS layer FROM named) WHERE {bad}"
        told = ["CASE layer " + " ".join(f"WHEN {quoted(x.name)} THEN {quoted(sep.join(x.names))}" for x in layers) + " END" for sep in (" or ", ", ")]
        return _rows(p, r, source, _text("File '{name}' in layer '{layer}' does not match naming convention: ") + f" || {told[0]}", f"'Rename to match one of: ' || {told[1]}")
    if r.type == "FILE_ORGANIZATION":
        return " UNION ALL ".join(
            _rows(p, r, f"named WHERE {_layer(p.layers)} IS NULL AND {_named(x)}", _text(f"File '{{path}}' matches naming for layer '{x.name}' but is not in the expected directory."), quoted("Move this file to a directory matching: " + ", ".join(x.globs)), "INFO")
            for x in p.layers
        )
    if r.type == "SINGLE_RESPONSIBILITY":
        a, b = r.config["max_methods_per_class"], r.config["max_lines_per_class"]
        many = _rows(p, r, f"sized WHERE methods > {a}", _text(f"Class has {{methods}} methods (max: {a}). Consider splitting responsibilities."), quoted("Extract related methods into separate classes with focused responsibilities."))
        long = _rows(p, r, f"sized WHERE lines > {b}", _text(f"File has {{lines}} lines (max: {b}). May have multiple responsibilities."), quoted("Consider breaking this file into smaller, focused modules."), "INFO")
        return f"{many} UNION ALL {long}"
    if r.type == "INTERFACE_SEGREGATION":
        a = r.config["max_interface_methods"]
        message = _text(f"Interface has {{methods}} methods (max: {a}). Consider splitting into smaller interfaces.")
        return _rows(p, r, f"sized WHERE interface AND methods > {a}", message, quoted("Split this interface into smaller, client-specific interfaces."))
    a = r.config["max_import_count"]
    fix = quoted("Reduce dependencies by introducing a facade, mediator, or splitting responsibilities.")
    return _rows(p, r, f"sized WHERE imported > {a}", _text(f"File has {{imported}} imports (max: {a}), indicating high coupling."), fix, sure=0.85)


_FACTS = r"""
targets AS MATERIALIZED (SELECT path, target, max(line_no) OVER (PARTITION BY path, target) AS line_no, string_split(replace(lower(target), '.', '/'), '/') AS segments FROM i WHERE target IS NOT NULL),
named AS MATERIALIZED (SELECT path, regexp_extract(stem, '[^/]*$') AS name FROM f),
counted AS (SELECT path, count(*) AS lines, count(*) FILTER (CASE language WHEN 'python' THEN starts_with(t, 'def ')
    WHEN 'typescript' THEN (contains(t, 'function ') OR regexp_matches(t, '\w\s*\(.*\)\s*[:{]')) AND NOT starts_with(t, '//') AND NOT starts_with(t, 'class ')
    ELSE (contains(t, 'fun ') OR regexp_matches(t, '(?:public|private|protected|static)\s+\w.*\(.*\)')) AND NOT (starts_with(t, '//') OR starts_with(t, '*') OR starts_with(t, 'class ') OR starts_with(t, 'interface ')) END) AS methods,
  bool_or(regexp_matches(t, CASE language WHEN 'python' THEN 'class\s+\w+.*\(.*ABC.*\)' ELSE '\binterface\s+\w' END)) AS interface FROM t GROUP BY path),
sized AS MATERIALIZED (SELECT counted.*, (SELECT count(*) FROM targets WHERE targets.path = counted.path) AS imported FROM counted)
"""
_FILE_RULES = " UNION ALL ".join(_rule(p, r) for p in built_in() for r in p.rules if r.type in SQL_RULES)
_FILE_LAYERS = " UNION ALL ".join(f"SELECT path, {quoted(p.name)} AS pattern, coalesce({_layer(p.layers)}, 'Unassigned') AS layer FROM code" for p in built_in() if p.layers)

ORACLES = {
    "code_scan": f"""WITH {CODE}, {IMPORTS}, {_FACTS}
SELECT path, language, class_name, methods::INTEGER AS method_count, lines::INTEGER AS line_count, interface AS is_interface, imported::INTEGER AS n_imports FROM sized JOIN code USING (path) JOIN f USING (path)""",
    "pattern_findings": f"WITH {CODE}, {IMPORTS}, {_FACTS} {_FILE_RULES}",
    "file_layers": f"WITH {CODE} {_FILE_LAYERS}",
}
