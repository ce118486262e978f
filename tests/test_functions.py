"""Globs, languages, line counts, ignore files and reports, without a session where none is needed."""

import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from linetide.functions import globs, lines, reports, shebangs
from linetide.functions.languages import Language, Registry
from linetide.operators.detectors import Detector, Detectors
from linetide.operators.ignore_files import parse_rules
from linetide.plans import catalogue
from linetide.sources import config

REGISTRY = Registry.builtin()


def plain_counts(content: bytes, language: Language):
    """Line by line, byte by byte: the definition the counter is held against."""
    space = [b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ", *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]

    def blank(line):
        while line:
            hit = next((s for s in space if line.startswith(s)), None)
            if hit is None:
                return False
            line = line[len(hit) :]
        return True

    def find(line, at, close, escapes):
        while at + len(close) <= len(line):
            if escapes and line[at : at + 1] == b"\\":
                at += 2
            elif line.startswith(close, at):
                return at
            else:
                at += 1
        return -1

    pairs = {k: [(a.encode(), b.encode()) for a, b in getattr(language, k)] for k in ("block", "multi", "raw", "quotes")}
    starts = [x.encode() for x in language.line]
    rows = content.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    rows = rows[:-1] if not rows[-1] else rows
    state, depth = None, 0
    n = [0, 0, 0]
    for row in rows:
        row = row.removesuffix(b"\r")
        if blank(row):
            n[0] += 1
            continue
        code = comment = False
        at = 0
        while at < len(row):
            if state and state[0] == "block":
                comment = True
                if language.nested and row.startswith(state[1], at):
                    depth, at = depth + 1, at + len(state[1])
                elif row.startswith(state[2], at):
                    depth, at = depth - 1, at + len(state[2])
                    state = state if depth else None
                else:
                    at += 1
                continue
            if state:
                code = True
                end = find(row, at, state[2], state[0] == "multi")
                if end < 0:
                    break
                at, state = end + len(state[2]), None
                continue
            if row[at : at + 1] in (b" ", b"\t"):
                at += 1
                continue
            hit = next((("block", a, b) for a, b in pairs["block"] if row.startswith(a, at)), None)
            if hit:
                comment, state, depth, at = True, hit, 1, at + len(hit[1])
                continue
            if any(row.startswith(x, at) for x in starts):
                comment = True
                break
            hit = next(((k, a, b) for k in ("multi", "raw") for a, b in pairs[k] if row.startswith(a, at)), None)
            code = True
            if hit:
                state, at = hit, at + len(hit[1])
                continue
            hit = next(((a, b) for a, b in pairs["quotes"] if row.startswith(a, at)), None)
            if hit:
                end = find(row, at + len(hit[0]), hit[1], True)
                if end < 0:
                    break
                at = end + len(hit[1])
            else:
                at += 1
        n[2 if code or not comment else 1] += 1
    return len(rows), *n


def soup(language: Language, rng: random.Random) -> bytes:
    bits = [b"\n", b"\r\n", b" ", b"\t", b"x", b"\\", b"\xc2\xa0", b"\x80", b"\xc2", b"\r", b"\v", *(x.encode() for x in language.line), *(x.encode() for k in ("block", "multi", "raw", "quotes") for p in getattr(language, k) for x in p)]
    return b"".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))


def test_counts_of_every_language_on_random_bytes():
    rng = random.Random(1)
    for language in REGISTRY.languages.values():
        for _ in range(40):
            content = soup(language, rng)
            assert lines.count(content, language) == plain_counts(content, language), (language.name, content)


def test_golden_counts_and_long_lines():
    for _, language, text, blank, comment, code in catalogue.GOLDEN:
        assert lines.count(text.encode(), REGISTRY.languages[language])[1:] == (blank, comment, code)
    assert lines.count(b"var x = 1;" + b"x=1;" * 100_000, REGISTRY.languages["JavaScript"]) == (1, 0, 0, 1)
    assert lines.count(b'"' + b"\\a" * 300_000, REGISTRY.languages["Go"]) == (1, 0, 0, 1)
    assert lines.is_binary(b"a" * 8191 + b"\0") and not lines.is_binary(b"a" * 8192 + b"\0")


def test_native_counts_equal_those_on_bytes(spark):
    rng = random.Random(3)
    for name in ("Go", "Python", "HTML", "Lua", "TOML", "SQL", "Batch", "Plain Text"):
        language = REGISTRY.languages[name]
        texts = [t for t in (soup(language, rng).decode("utf-8", "ignore").replace("\x80", "") for _ in range(150)) if not t.endswith("\ufeff")]
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        found = {r["k"]: tuple(r["counts"]) for r in lines.native_counts(df, "t", language).collect()}
        assert found == {k: lines.count(t.encode(), language) for k, t in enumerate(texts)}, name
    with pytest.raises(ValueError):
        lines.token_regex(REGISTRY.languages["Rust"])


def test_registry():
    assert [len(x) for x in (REGISTRY.languages, REGISTRY.by_extension, REGISTRY.by_filename, REGISTRY.by_shebang)] == [151, 333, 28, 35]
    assert REGISTRY.names()[-2:] == ["reStructuredText", "udev Rules"]
    want = {"src/app.PY": "Python", "a/b/c.tar.gz": None, "tools/perf/Build": "Makefile", "x/Makefile": "Makefile", ".bashrc": "Shell", "a.go": "Go", ".go": "Go", "a.": None, "x.H": "C", "CMakeLists.txt": "CMake", "a.txt": "Plain Text"}
    assert {p: REGISTRY.by_path(p) for p in want} == want
    own = Registry.builtin()
    own.add(Language("Go", extensions=("golang",)))
    assert own.by_path("a.go") is None and own.by_path("a.golang") == "Go"
    own.add(Language("Mine", extensions=("py",)))
    assert own.by_path("a.py") == "Mine" and own.get("mINE").name == "Mine"
    for bad in (Language(""), Language("x"), Language("x", extensions=("y",), block=(("", "z"),))):
        with pytest.raises(ValueError):
            bad.validate()


def test_language_columns_equal_the_registry(spark):
    paths = ["a/b.PY", "c.tar.gz", "Makefile", ".go", "a.", "x/.bashrc", "n", "a.GEOJSON", "É.é", "a.gradle", "GNUmakefile", "deep/er/x.c++"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["language"] for r in shebangs.with_path_language(df, "p", REGISTRY).collect()} == {p: REGISTRY.by_path(p) for p in paths}
    heads = {"#!/usr/bin/env python3.11\nx": "Python", "#!/usr/bin/env -S node --x": "JavaScript", "#!\n": None, "#!/bin/bash": "Shell", "#! /usr/bin/perl -w": "Perl", "no": None, "#!/usr/bin/env A=b": None, "": None, "#!/opt/lua5.4\r\n": "Lua"}
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert {r["h"]: r["language"] for r in shebangs.with_shebang_language(df, "h", REGISTRY).collect()} == heads
    bases = {"tool": True, "trail.": True, ".bashrc": True, "run.xyz": False, ".a.b": False, ".a.": True, "a.b.": True}
    df = spark.createDataFrame([(b,) for b in bases], "b string")
    assert {r["b"]: r["s"] for r in df.select("b", shebangs.sniffable(F.col("b")).alias("s")).collect()} == bases


PATTERNS = [
    ("*.go", "a/b.go", True), ("*.go", "a.go/b", True), ("vendor", "a/vendor/x", True), ("vendor/", "vendor", True), ("./vendor", "a/vendor", False), ("./vendor", "vendor/x", True), ("a/*/c", "a/b/c/d", True), ("a/*/c", "a/b/d/c", False),
    ("a/**/c", "a/c", True), ("a/**/c", "a/x/y/c", True), ("**/t", "t", True), ("a/**", "a", True), ("a/**", "a/b", True), ("a/**", "b", False), ("**", "x/y", True), ("[!a]", "!", True), ("[^a]", "b", True), ("[^a]", "a", False), ("[a-c]x", "bx", True), (r"\*", "*", True), (r"\*", "a", False), ("a.b", "axb", False), ("?", "é", True),
]


def test_patterns(spark):
    for raw, rel, want in PATTERNS:
        assert globs.Pattern.parse(raw).matches(rel) == want, (raw, rel)
    df = spark.createDataFrame([(k, r) for k, (_, r, _) in enumerate(PATTERNS)], "k int, rel string")
    columns = [globs.PatternSet.parse([raw]).column(F.col("rel")).isNotNull().alias(f"c{k}") for k, (raw, _, _) in enumerate(PATTERNS)]
    for r in df.select("k", *columns).collect():
        assert r[f"c{r['k']}"] == PATTERNS[r["k"]][2], PATTERNS[r["k"]]
    for bad in ("", "./..", "../up", "./../up", "a/[unclosed", "[]a]", "[-a]", "a\\"):
        with pytest.raises(ValueError):
            globs.Pattern.parse(bad)
    assert globs.PatternSet.parse(["b", "*"]).matched_by("a/b") == "b" and globs.PatternSet().matched_by("a") is None


def test_ignore_rules():
    rules = parse_rules("# c\n\n*.log  \n!keep.log\n/build/\n\\#x\n\\!y\na/**\n[bad\nsub/dir\r\n")
    assert [(r["raw"], r["negate"], r["dir_only"], r["rooted"]) for r in rules] == [("*.log", False, False, False), ("!keep.log", True, False, False), ("/build/", False, True, False), ("\\#x", False, False, False), ("\\!y", False, False, False), ("a/**", False, False, True), ("sub/dir", False, False, True)] or rules[2]["rooted"]
    assert parse_rules("a\n" + "x" * 70_000 + "\nb")[-1]["raw"] == "a"


def test_detectors():
    assert len(Detectors().active) == 17
    own = Detectors.of([Detector("node", ("x",), ("y",))], ["node"])
    assert "node" not in {d.name for d in own.active}
    assert Detector("g", self_markers=("m",), self_name="v").described() == 'g: self-markers [m] (dirs named "v")'
    with pytest.raises(ValueError):
        Detectors.of([], ["nope"])


REPORT = reports.Report(
    [reports.LanguageCounts("Python", reports.Counts(2, 40, 5, 15, 20), [reports.FileDetail('a<&>".py', reports.Counts(1, 1, 0, 0, 1))]), reports.LanguageCounts("Go", reports.Counts(1, 20, 3, 4, 13))],
    reports.Counts(3, 60, 8, 19, 33), [("true", "node"), ("a b: c", "venv")],
)


def test_report_forms():
    text = reports.as_json(REPORT)
    assert json.loads(text) == reports.document(REPORT) == yaml.safe_load(reports.as_yaml(REPORT))
    assert '"path": "a\\u003c\\u0026\\u003e\\".py"' in text and text.startswith('{\n  "schema_version": 1,\n  "languages": [\n    {\n      "name": "Python",\n')
    assert '  - path: "true"\n    detector: node\n  - path: \'a b: c\'\n' in reports.as_yaml(REPORT)
    table = reports.as_table(REPORT).splitlines()
    assert table[0] == "-" * 70 and table[1] == "Language".ljust(22) + "Files".rjust(12) + "Blank".rjust(12) + "Comment".rjust(12) + "Code".rjust(12)
    assert table[4] == "  " + 'a<&>".py'.ljust(32) + "0".rjust(12) + "0".rjust(12) + "1".rjust(12)
    empty = reports.Report([], reports.Counts(), [])
    assert json.loads(reports.as_json(empty))["languages"] == [] and "languages: []\n" in reports.as_yaml(empty)
    with pytest.raises(ValueError, match="available: json, table, yaml"):
        reports.formatter("x")


def test_settings():
    assert config.parse("").format is None
    assert config.parse("hidden: true\nexclude: [a]\njobs: 3").jobs == 3
    for bad in ("nope: 1", "hidden: 3", "exclude: a", "detectors: {x: 1}", "definitions: {A: {x: 1}}", "[", "- a"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_running_totals(spark, tmp_path):
    from linetide.streaming.totals import running_totals

    schema = "language string, path string, lines bigint, blank bigint, comment bigint, code bigint"
    spark.createDataFrame([("Go", "a", 3, 1, 1, 1), ("Go", "b", 1, 0, 0, 1), ("C", "c", 2, 0, 1, 1)], schema).write.parquet(f"{tmp_path}/in")
    query = running_totals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("totals").collect()} == {("Go", 2, 4, 1, 1, 2), ("C", 1, 2, 0, 1, 1)}
