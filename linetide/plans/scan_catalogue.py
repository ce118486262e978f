"""Queries of whole scans over a small tree that holds a case of every rule; their SQL lists the rows to be found.

A tree has what no table has: links, unreadable files, several roots, ignore files on several levels, markers of
every detector.  So the entries and contents are written down here, and the expected rows beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reports, shebangs
from ..functions.globs import PatternSet
from ..functions.languages import Registry
from ..functions.lines import classify
from ..operators import cascade
from ..operators.detectors import Detectors
from ..sources import config
from . import scan

#: Path, kind and content; a file without content cannot be read.
TREE = [
    ("main.go", "file", "package main\n\n// says hello\nfunc main() {}\n"), ("same.go", "file", "package main\n\n// says hello\nfunc main() {}\n"), ("gen_main.go", "file", "package gen\n"),
    ("link.go", "symlink", None), ("pipe.go", "other", None), ("gone.go", "broken", None), ("locked", "unreadable", None),
    (".git", "dir", None), (".git/config.py", "file", "x = 1\n"), (".env.py", "file", "x = 1\n"), (".cache", "dir", None), (".cache/a.py", "file", "x = 1\n"),
    (".gitignore", "file", "*.log.py\n!kept.log.py\n/out/\n# /sub/\n"), ("a.log.py", "file", "x = 1\n"), ("kept.log.py", "file", "x = 1\n"), ("out", "dir", None), ("out/o.py", "file", "x = 1\n"),
    ("sub", "dir", None), ("sub/.gitignore", "file", "!a.log.py\ndraft.py\n/deep/only.py\n"), ("sub/a.log.py", "file", "x = 2\n"), ("sub/b.log.py", "file", "x = 3\n"), ("sub/draft.py", "file", "x = 4\n"), ("sub/out", "dir", None), ("sub/out/p.py", "file", "x = 5\n"),
    ("sub/deep", "dir", None), ("sub/deep/.gitignore", "file", "!draft.py\n"), ("sub/deep/draft.py", "file", "# a\nx = 6\n"), ("sub/deep/only.py", "file", "x = 7\n"), ("sub/deep/a.log.py", "file", "x = 8\n"),
    ("web", "dir", None), ("web/package.json", "file", "{}\n"), ("web/node_modules", "dir", None), ("web/node_modules/a.js", "file", "a()\n"), ("web/src", "dir", None), ("web/src/node_modules", "dir", None), ("web/src/node_modules/b.js", "file", "b()\n"),
    ("env", "dir", None), ("env/pyvenv.cfg", "file", "home = x\n"), ("env/lib.py", "file", "x = 9\n"), ("node_modules", "dir", None), ("node_modules/kept.js", "file", "// c\nk()\n"),
    ("run", "file", "#!/usr/bin/env python3.12\n# a\nx = 10\n"), ("tool", "file", "#!/opt/none\n"), ("notes", "file", "plain\n"), ("data.xyz", "file", "?\n"), ("bytes.c", "file", "a\0b"), ("bytes", "file", "#!/bin/sh\n\0\n"), ("lost.py", "file", None), ("lost", "file", None),
    ("Makefile", "file", "all:\n\techo # no\n# yes\n"), ("empty.py", "file", ""),
]
_ENTRY = "root int, prefix string, abs string, rel string, kind string, size bigint, error string"
_COUNTS = "language, path, lines, blank, comment, code"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _values(rows: list[tuple], columns: str) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _query(rows: list[tuple], columns: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _values(rows, columns)
        return f

    return keep


def _long(sql_columns: str) -> str:
    return ", ".join(f"CAST({x} AS BIGINT) AS {x}" if x in ("lines", "blank", "comment", "code", "files", "n") else x for x in sql_columns.split(", "))


def _counted(rows: list[tuple], columns: str = _COUNTS):
    def keep(f):
        _query(rows, columns)(f)
        ORACLES[f.__name__] = f"SELECT {_long(columns)} FROM ({ORACLES[f.__name__]})"
        return f

    return keep


def _scanned(spark: SparkSession, options: scan.Options, tracked: list[str] | None = None, again: tuple[str, ...] = ()) -> scan.Scan:
    """A scan of the tree; ``again`` are paths that a second root reaches as well."""
    error = {"broken": "No such file or directory", "unreadable": "Permission denied"}
    rows = [(0, "t", f"/t/{rel}", rel, kind, None, error.get(kind)) for rel, kind, _ in TREE]
    rows += [(1, "t/sub", f"/t/{rel}", rel.removeprefix("sub/"), "file", None, None) for rel in again]
    entries = spark.createDataFrame(rows, _ENTRY)
    contents = spark.createDataFrame([(f"/t/{rel}", None if text is None else text.encode()) for rel, kind, text in TREE if kind == "file"], "abs string, content binary")
    ignore = spark.createDataFrame([(0, rel.rpartition("/")[0], text) for rel, _, text in TREE if rel.endswith(".gitignore")], "root int, dir string, content string")

    def read(files: DataFrame, most: int | None) -> DataFrame:
        found = files.join(contents, "abs", "left").select(*files.columns, "content")
        found = found if most is None else found.withColumn("content", F.substring("content", 1, most))
        return found.withColumn("read_error", F.when(F.col("content").isNull(), "Permission denied"))

    index = None if tracked is None else spark.createDataFrame([(0, x) for x in tracked], "root int, rel string")
    return scan.scan_entries(entries, ignore, options, read, index, bool(again))


def _rules(**given) -> cascade.Rules:
    return cascade.Rules(exclude=PatternSet.parse(["gen_*"]), **given)


_HIDDEN = "hidden; use --hidden to count"
_KEPT = [
    ("Go", "t/main.go", 4, 1, 1, 2), ("Go", "t/same.go", 4, 1, 1, 2), ("Python", "t/kept.log.py", 1, 0, 0, 1), ("Python", "t/sub/a.log.py", 1, 0, 0, 1), ("Python", "t/sub/out/p.py", 1, 0, 0, 1), ("Python", "t/sub/deep/draft.py", 2, 0, 1, 1),
    ("Python", "t/sub/deep/a.log.py", 1, 0, 0, 1), ("JSON", "t/web/package.json", 1, 0, 0, 1), ("JavaScript", "t/node_modules/kept.js", 2, 0, 1, 1), ("Python", "t/run", 3, 0, 2, 1), ("Makefile", "t/Makefile", 3, 0, 1, 2), ("Python", "t/empty.py", 0, 0, 0, 0),
]


@_counted(_KEPT)
def scan_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a scan counts, with their lines: by name, by shebang, through ignore files on three levels."""
    return _scanned(spark, scan.Options(rules=_rules())).files


_TRACE = [
    ("t/link.go", False, "symlink", "symlink; --follow-symlinks off"), ("t/.git", True, "vcs", "vcs metadata"), ("t/.env.py", False, "hidden", _HIDDEN), ("t/.cache", True, "hidden", _HIDDEN), ("t/.gitignore", False, "hidden", _HIDDEN),
    ("t/sub/.gitignore", False, "hidden", _HIDDEN), ("t/sub/deep/.gitignore", False, "hidden", _HIDDEN), ("t/gen_main.go", False, "excluded", 'excluded by pattern "gen_*"'), ("t/web/node_modules", True, "smart", "smart: node"), ("t/web/src/node_modules", True, "smart", "smart: node"),
    ("t/env", True, "smart", "smart: venv"), ("t/a.log.py", False, "gitignored", 'gitignored by .gitignore: "*.log.py"'), ("t/out", True, "gitignored", 'gitignored by .gitignore: "/out/"'), ("t/sub/b.log.py", False, "gitignored", 'gitignored by .gitignore: "*.log.py"'),
    ("t/sub/draft.py", False, "gitignored", 'gitignored by sub/.gitignore: "draft.py"'), ("t/sub/deep/only.py", False, "gitignored", 'gitignored by sub/.gitignore: "/deep/only.py"'), ("t/data.xyz", False, "unknown", "unknown language"), ("t/notes", False, "unknown", "unknown language"), ("t/tool", False, "unknown", "unknown language"),
]


@_query(_TRACE, "path, is_dir, reason, detail")
def scan_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry that a scan leaves out by a rule of its own, and why."""
    return _scanned(spark, scan.Options(rules=_rules())).decisions.select("path", "is_dir", "reason", "detail")


@_query([("t/web/node_modules", "node"), ("t/web/src/node_modules", "node"), ("t/env", "venv")], "path, detector")
def scan_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories that detectors leave out, as a report lists them."""
    return _scanned(spark, scan.Options(rules=_rules())).excluded


@_query([("t/bytes.c", "skipping binary file t/bytes.c"), ("t/bytes", "skipping binary file t/bytes"), ("t/lost.py", "cannot read t/lost.py: Permission denied"), ("t/lost", "cannot read t/lost: Permission denied"), ("t/gone.go", "broken symlink t/gone.go: No such file or directory"), ("t/locked", "cannot read directory t/locked: Permission denied")], "path, warning")
def scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan warns of: binary files, files and directories that cannot be read, links that lead nowhere."""
    return _scanned(spark, scan.Options(rules=_rules())).warnings


@_counted([r for r in _KEPT if r[1] in ("t/main.go", "t/sub/a.log.py", "t/run")] + [("Python", "t/.env.py", 1, 0, 0, 1)])
def scan_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files counted where only those in an index count, hidden ones too; an ignored file stays ignored."""
    return _scanned(spark, scan.Options(rules=_rules(hidden=True)), ["main.go", "sub/a.log.py", "sub/draft.py", "run", ".env.py", "gen_main.go"]).files


@_query([("t/same.go", "duplicate", "duplicate of t/main.go"), ("t/kept.log.py", "duplicate", "duplicate of t/a.log.py"), ("t/out/o.py", "duplicate", "duplicate of t/a.log.py"), ("t/sub/a.log.py", "seen", "already counted via another root")], "path, reason, detail")
def scan_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one content, and files that a second root reaches again."""
    found = _scanned(spark, scan.Options(rules=_rules(gitignore=False), dedup=True), again=("sub/a.log.py",)).decisions
    return found.where("reason in ('duplicate', 'seen')").select("path", "reason", "detail")


@_query([("t/Makefile", "extension", "extension not selected by --ext"), ("t/data.xyz", "extension", "extension not selected by --ext"), ("t/lost", "extension", "extension not selected by --ext"), ("t/run", "extension", "extension not selected by --ext"), ("t/notes", "extension", "extension not selected by --ext"), ("t/tool", "extension", "extension not selected by --ext"),
         ("t/bytes", "extension", "extension not selected by --ext"), ("t/web/package.json", "extension", "extension not selected by --ext"), ("t/env/pyvenv.cfg", "extension", "extension not selected by --ext"), ("t/main.go", "language", "language Go not selected by --lang"), ("t/same.go", "language", "language Go not selected by --lang")], "path, reason, detail")
def scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a choice of extensions and of languages leaves out, without detectors."""
    found = _scanned(spark, scan.Options(rules=_rules(detectors=None), extensions={"go", "py", "js", "c"}, languages={"python", "javascript", "c"})).decisions
    return found.where("reason in ('extension', 'language')").select("path", "reason", "detail")


@_query([("t/run", "language", "language Python not selected by --lang"), ("t/bytes", "language", "language Shell not selected by --lang")], "path, reason, detail")
def scan_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose language only their shebang tells, where another one is chosen."""
    found = _scanned(spark, scan.Options(rules=_rules(), languages={"go"})).decisions
    return found.where("path in ('t/run', 't/bytes')").select("path", "reason", "detail")


@_counted([r for r in _KEPT if r[0] in ("JavaScript", "JSON")], _COUNTS)
def scan_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files counted where only some patterns are included."""
    return _scanned(spark, scan.Options(rules=_rules(include=PatternSet.parse(["*.js", "web/**"])))).files


#: A marker of each detector, a directory that it excludes (or marks itself), and one of the same name without a marker above.
MARKED = [
    ("node", "package.json", "bower_components"), ("composer", "composer.json", "vendor"), ("python", "Pipfile", "x.egg-info"), ("rust", "Cargo.toml", "target"), ("maven", "pom.xml", "target"), ("gradle", "build.gradle.kts", ".gradle"),
    ("ruby", "Gemfile", "vendor/bundle"), ("dotnet", "App.fsproj", "obj"), ("elixir", "mix.exs", "deps"), ("dart", "pubspec.yaml", "build"), ("swift", "Package.swift", ".build"), ("terraform", "main.tf", ".terraform"), ("zig", "build.zig", "zig-out"), ("haskell", "x.cabal", "dist-newstyle"),
]
SELF = [("venv", "pyvenv.cfg", "any"), ("go", "modules.txt", "vendor"), ("cmake", "CMakeCache.txt", "out")]


@_query([(f"{d}/in/{x}", d) for d, _, x in MARKED] + [(f"{d}/{x}", d) for d, _, x in SELF], "rel, detector")
def detectors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each built-in detector the directory that its marker excludes; the same name without a marker stays."""
    files = [f"{d}/{m}" for d, m, _ in MARKED] + [f"{d}/in/{x}/f" for d, _, x in MARKED] + [f"none-{d}/in/{x}/f" for d, _, x in MARKED] + [f"{d}/{x}/{m}" for d, m, x in SELF] + ["go/other/modules.txt"]
    dirs = {f.rsplit("/", k)[0] for f in files for k in range(1, f.count("/") + 1)}
    rows = [(0, "", x, x, kind) for kind, names in (("file", files), ("dir", sorted(dirs))) for x in names]
    entries = cascade.entry_columns(spark.createDataFrame(rows, "root int, prefix string, abs string, rel string, kind string"))
    own = Detectors()
    return own.excluded(entries).union(own.self_excluded(entries)).select("rel", "detector")


SETTINGS = """
definitions:
  Alpha: {extensions: [al, py], line_comments: ['%%'], block_comments: [['{%', '%}']], nested_comments: true}
  Beta: {filenames: [Betafile], shebangs: [beta], quotes: [['"', '"']], line_comments: [';']}
  Go: {extensions: [golang], line_comments: ['//']}
detectors:
  disable: [node]
"""
_CUSTOM = [
    ("a.al", "%% c\nx %% y\n", "Alpha", 2, 0, 1, 1), ("b.py", "{% a {% b %}\n%} c\n# d\n{% e %}\n", "Alpha", 4, 0, 2, 2), ("x/Betafile", '; c\n"; s"\n\n', "Beta", 3, 1, 1, 1), ("c.golang", "// c\n/* d */\n", "Go", 2, 0, 1, 1), ("d.go", "// c\n", None, None, None, None, None),
]


@_counted([(p, g, *n) for p, _, g, *n in _CUSTOM], "path, language, lines, blank, comment, code")
def custom_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that settings define: a new one that takes an extension over, one by file name, one that replaces a built-in one."""
    registry = Registry.builtin()
    config.parse(SETTINGS).apply_definitions(registry)
    rows = spark.createDataFrame([(p, t.encode()) for p, t, *_ in _CUSTOM], "path string, content binary")
    named = shebangs.with_path_language(rows, "path", registry)
    return classify(named, "content", "language", registry, ["path", "language"]).drop("is_binary")


@_query([("x.py", True, "python"), ("x", True, "python"), (".x", True, "python"), ("x.", True, "shell"), (".x.y", False, None), ("a.b.c", False, None), ("noext", True, None)], "base, sniffed, program")
def shebang_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names are searched for a shebang, and the program that each text's first line names."""
    heads = {"x.py": "#!/usr/bin/python\n", "x": "#!/usr/bin/env python\n", ".x": "#! /usr/bin/env -S python -u\n", "x.": "#!/bin/shell", ".x.y": "#!\n", "a.b.c": " #!/bin/sh\n", "noext": "#!/usr/bin/env\n"}
    rows = spark.createDataFrame(list(heads.items()), "base string, head string")
    return rows.select("base", (shebangs.sniffable(F.col("base")) | (F.col("base") == "x.py")).alias("sniffed"), shebangs.interpreter(F.col("head")).alias("program"))


@_query([(1, "A much longer name of a language"), (2, "Go"), (3, "Python"), (4, "Zig")], "n, language")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of languages in a report: the most code first, then by name."""
    rows = [("Zig", 1), ("Python", 2), ("Go", 2), ("A much longer name of a language", 9)]
    files = spark.createDataFrame([(g, f"{g}/f", k, 0, 0, k) for g, k in rows], "language string, path string, lines bigint, blank bigint, comment bigint, code bigint")
    return spark.createDataFrame([(k, x.name) for k, x in enumerate(reports.build(files).languages, 1)], "n int, language string")


@_query([(x,) for x in (
    "-" * 82, "Language" + " " * 26 + "       Files       Blank     Comment        Code", "-" * 82, "A much longer name of a language  " + "           1           1           2           6", "  b/f.x" + " " * 39 + "           1           2           6",
    "Go" + " " * 32 + "           1           0           0           2", "  a/f.go" + " " * 38 + "           0           0           2", "-" * 82, "Total" + " " * 29 + "           2           1           2           8", "-" * 82)], "line")
def report_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a table with files under their languages and a wide name."""
    files = spark.createDataFrame([("Go", "a/f.go", 2, 0, 0, 2), ("A much longer name of a language", "b/f.x", 9, 1, 2, 6)], "language string, path string, lines bigint, blank bigint, comment bigint, code bigint")
    return spark.createDataFrame([(x,) for x in reports.as_table(reports.build(files, by_file=True)).splitlines()], "line string")
