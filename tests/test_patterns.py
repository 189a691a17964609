"""Architecture patterns: sources, globs, layers and rules."""

import re

import pytest

from sourcelake.operators import methods, patterns, scan
from sourcelake.sources.patterns import Layer, Pattern, Rule, built_in, from_json, from_mapping

GLOBS = [
    ("**/model/**", "src/model/A.kt", True), ("**/model/**", "model/A.kt", False), ("**/model/**", "src/models/A.kt", False), ("src/*.kt", "src/A.kt", True), ("src/*.kt", "src/a/A.kt", False),
    ("**/*.{kt,java}", "a/b.java", True), ("**/*.{kt,java}", "a/b.py", False), ("?[a-c].kt", "xb.kt", True), ("?[a-c].kt", "xd.kt", False), ("[!a].kt", "b.kt", True), ("[!a].kt", "a.kt", False), ("a+b(c).kt", "a+b(c).kt", True),
]


@pytest.mark.parametrize("glob, path, fits", GLOBS)
def test_globs(glob, path, fits):
    assert bool(re.fullmatch(patterns.glob_expression(glob), path, re.S)) == fits


def test_globs_in_spark(spark):
    rows = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(GLOBS)], "i int, path string")
    for i, (glob, _, fits) in enumerate(GLOBS):
        assert rows.where(rows["i"] == i).select(patterns.matches_glob(rows["path"], glob)).first()[0] == fits


def test_sources():
    found = {p.name: p for p in built_in()}
    assert len(found) == 12 and [x.name for x in found["MVC"].layers] == ["model", "view", "controller"]
    assert found["MVC"].layers[2].allowed == ("model", "view") and "**/core/model/**" in found["Clean Architecture"].layers[0].globs
    assert found["Factory / Creational Patterns"].rules[1].config["max_methods_per_class"] == 8 and found["Repository Pattern"].layers[0].names[-1] == "I.*Repository$"
    own = from_json('{"name": "Own", "layers": [{"name": "a", "file_patterns": ["a/*"]}], "rules": [{"id": "x", "severity": "error", "type": "naming_convention"}, {"severity": "odd", "type": "odd"}]}')
    assert own == Pattern("Own", (Layer("a", ("a/*",)),), (Rule("x", "", "ERROR", "NAMING_CONVENTION"), Rule("", "", "WARNING", "FILE_ORGANIZATION")))
    for broken in ({}, {"name": "x", "layers": [{}]}, {"name": 3}):
        with pytest.raises(ValueError):
            from_mapping(broken)


FILES = [
    ("src/model/UserModel.kt", "kotlin", "import app.view.UserView\nimport app.model.Other\nimport app.view.UserView\nclass UserModel"),
    ("src/view/Odd.kt", "kotlin", "import app.model.UserModel\nclass Odd"),
    ("src/controller/UserController.kt", "kotlin", "import app.model.UserModel\nimport app.View.X\nclass UserController {\n val s = Service()\n}"),
    ("src/other/LoginController.kt", "kotlin", "class LoginController"),
    ("src/other/free.kt", "kotlin", None),
]


@pytest.fixture
def scanned(spark):
    return scan.scan_files(spark.createDataFrame(FILES, "path string, language string, text string"))


def test_layers(scanned):
    mvc = [p for p in built_in() if p.name == "MVC"]
    assert {r["path"]: r["layer"] for r in patterns.classified(scanned, tuple(mvc)).collect()} == {
        "src/model/UserModel.kt": "model", "src/view/Odd.kt": "view", "src/controller/UserController.kt": "controller", "src/other/LoginController.kt": "Unassigned", "src/other/free.kt": "Unassigned",
    }
    got = sorted((r["rule_id"], r["path"], r["line_no"], r["severity"], r["message"]) for r in patterns.file_findings(scanned, tuple(mvc)).collect())
    broken = "Layer 'model' should not depend on 'view'. Import 'app.view.UserView' violates dependency direction."
    assert got == [
        ("mvc-layer-dep", "src/model/UserModel.kt", 3, "ERROR", broken), ("mvc-layer-dep", "src/model/UserModel.kt", 3, "ERROR", broken),
        ("mvc-naming", "src/view/Odd.kt", 1, "WARNING", "File 'Odd' in layer 'view' does not match naming convention: .*View$ or .*Page$ or .*Component$ or .*Template$ or .*Screen$ or .*Fragment$"),
        ("mvc-organization", "src/other/LoginController.kt", 1, "INFO", "File 'src/other/LoginController.kt' matches naming for layer 'controller' but is not in the expected directory."),
    ]


def test_sizes_and_methods(spark):
    big = "interface Big {\n" + "\n".join(f"    fun f{i}(a: Int, b: Int, c: Int, d: Int, e: Int, f: Int): Int" for i in range(12)) + "\n}"
    branchy = "class B {\n    fun run(a: Int) {\n" + "        if (a == 1 && a > 0) { x() }\n" * 11 + "    }\n    keep(Database())\n}"
    files = spark.createDataFrame([("a.kt", "kotlin", big), ("b.kt", "kotlin", branchy), ("c.kt", "kotlin", "import q.W\n" * 16)], "path string, language string, text string")
    solid = tuple(p for p in built_in() if p.name in ("SOLID Principles", "Code Quality"))
    got = {(r["rule_id"], r["path"], r["message"]) for r in patterns.file_findings(scan.scan_files(files), solid).collect()}
    assert ("solid-srp", "a.kt", "Class has 12 methods (max: 10). Consider splitting responsibilities.") in got and ("solid-isp", "a.kt", "Interface has 12 methods (max: 5). Consider splitting into smaller interfaces.") in got
    assert ("solid-dip", "b.kt", "Direct instantiation of concrete class 'Database'. Depend on abstractions instead.") in got
    assert ("quality-coupling", "c.kt", "File has 16 imports (max: 15), indicating high coupling.") in got and not any(r == "quality-srp" for r, *_ in got)
    rows = {(r["rule_id"], r["severity"]): r["confidence"] for r in patterns.method_findings(methods.method_table(files), solid).where("path = 'b.kt'").collect()}
    assert rows["quality-cyclomatic", "ERROR"] == pytest.approx(min(0.99, 23 / 30))


def test_nothing(spark):
    none = scan.scan_files(spark.createDataFrame([], "path string, language string, text string"))
    assert patterns.file_findings(none, built_in()).collect() == [] and patterns.file_findings(none, ()) is None
