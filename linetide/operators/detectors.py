"""Ecosystem detectors: marker files switch on excluded directories below, self-markers exclude a directory itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import BadGlob, java, segment_regex
from .ignore_files import ancestors, sent_if_few


@dataclass(frozen=True)
class Detector:
    """Markers and the directories they exclude; self-markers and the only name they then hold for, if any."""

    name: str
    markers: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    self_markers: tuple[str, ...] = ()
    self_name: str = ""

    def described(self) -> str:
        """The line of a listing."""
        line = f"{self.name}:"
        if self.markers:
            line += f" markers [{' '.join(self.markers)}] -> exclude [{' '.join(self.exclude)}]"
        if self.self_markers:
            line += f" self-markers [{' '.join(self.self_markers)}]"
            if self.self_name:
                line += f' (dirs named "{self.self_name}")'
        return line


def _detector(name: str, markers: str = "", exclude: str = "", self_markers: str = "", self_name: str = "") -> Detector:
    return Detector(name, tuple(markers.split()), tuple(exclude.split()), tuple(self_markers.split()), self_name)


# The built-in detectors, in order.
BUILTIN = [
    _detector("node", "package.json", "node_modules .pnpm-store bower_components"),
    _detector("composer", "composer.json", "vendor"),
    _detector("python", "pyproject.toml setup.py setup.cfg requirements.txt Pipfile", "__pycache__ .venv venv .tox .nox .mypy_cache .pytest_cache .ruff_cache .eggs *.egg-info"),
    _detector("venv", self_markers="pyvenv.cfg"),
    _detector("rust", "Cargo.toml", "target"),
    _detector("go", self_markers="modules.txt", self_name="vendor"),
    _detector("maven", "pom.xml", "target"),
    _detector("gradle", "build.gradle build.gradle.kts settings.gradle settings.gradle.kts", "build .gradle"),
    _detector("ruby", "Gemfile", ".bundle vendor/bundle"),
    _detector("dotnet", "*.sln *.csproj *.fsproj", "bin obj"),
    _detector("elixir", "mix.exs", "_build deps .elixir_ls"),
    _detector("dart", "pubspec.yaml", ".dart_tool build"),
    _detector("swift", "Package.swift", ".build"),
    _detector("terraform", "*.tf", ".terraform"),
    _detector("cmake", self_markers="CMakeCache.txt"),
    _detector("zig", "build.zig", "zig-cache .zig-cache zig-out"),
    _detector("haskell", "stack.yaml *.cabal", ".stack-work dist-newstyle"),
]


@dataclass
class Detectors:
    """The active detectors, in order."""

    active: list[Detector] = field(default_factory=lambda: list(BUILTIN))

    @classmethod
    def of(cls, custom: list[Detector] | None = None, disabled: list[str] | None = None) -> Detectors:
        every = [*BUILTIN, *(custom or [])]
        names = {d.name for d in every}
        for x in disabled or []:
            if x not in names:
                raise ValueError(f'unknown detector "{x}" (see --list-detectors)')
        return cls([d for d in every if d.name not in set(disabled or [])])

    def _hits(self, entries: DataFrame, of: str) -> DataFrame:
        """``root, dir, det_ord`` of the directories that hold a marker: one pass over the names, which are then few."""
        name, found = F.col("name"), []
        for k, d in enumerate(self.active):
            holds, literals = F.lit(False), []
            for m in getattr(d, of):
                if re.search(r"[*?\[\\]", m):
                    try:
                        holds = holds | name.rlike(java(segment_regex(m)))
                    except BadGlob:
                        continue
                else:
                    literals.append(m)
            if getattr(d, of):
                found.append(F.when(holds | name.isin(*literals) if literals else holds, F.lit(k)))
        if not found:
            return entries.select("root", F.col("parent").alias("dir"), F.lit(-1).alias("det_ord")).where(F.lit(False))
        return entries.select("root", F.col("parent").alias("dir"), F.explode(F.array_compact(F.array(*found))).alias("det_ord")).distinct()

    def excluded(self, entries: DataFrame) -> DataFrame:
        """``root, rel, detector`` of the directories excluded by a marker above: innermost scope, then detector, then rule."""
        rules = []
        for k, d in enumerate(self.active):
            for j, x in enumerate(d.exclude):
                try:
                    rules.append((k, j, d.name, "/".join(segment_regex(s) for s in x.split("/")), x.count("/") + 1, segment_regex(x.split("/")[-1])))
                except BadGlob:
                    continue
        spark = entries.sparkSession
        if not rules:
            return spark.createDataFrame([], "root int, rel string, detector string")
        last = java("|".join(sorted({r[5] for r in rules})))
        found = entries.where(F.col("is_dir") & F.col("name").rlike(last)).select("root", "rel", F.explode(ancestors(F.col("rel"))).alias("up"))
        found = found.select("root", "rel", F.col("up.dir").alias("dir"), F.col("up.depth").alias("depth"))
        scoped = found.join(sent_if_few(self._hits(entries, "markers"))[0], ["root", "dir"])
        table = F.broadcast(spark.createDataFrame([(k, j, name, rf"(?s)\A(?:.*/)?{core}\z", n) for k, j, name, core, n, _ in rules], "det_ord int, rule_ord int, detector string, regex string, n int"))
        matched = scoped.join(table, "det_ord").where(F.expr("size(split(rel, '/')) - depth >= n and rel rlike regex"))
        return matched.groupBy("root", "rel").agg(F.min_by("detector", F.struct(-F.col("depth"), F.col("det_ord"), F.col("rule_ord"))).alias("detector"))

    def self_excluded(self, entries: DataFrame) -> DataFrame:
        """``root, rel, detector`` of the directories whose own listing marks them; never the root."""
        hits = self._hits(entries, "self_markers").where("dir <> ''")
        if not self.active:
            return hits.select("root", F.col("dir").alias("rel"), F.lit("").alias("detector"))
        names, only = (F.array(*map(F.lit, x)) for x in ([d.name for d in self.active], [d.self_name for d in self.active]))
        own = F.get(only, F.col("det_ord"))
        named = hits.where((own == "") | (own == F.substring_index("dir", "/", -1)))
        return named.groupBy("root", F.col("dir").alias("rel")).agg(F.min("det_ord").alias("det_ord")).select("root", "rel", F.get(names, F.col("det_ord")).alias("detector"))
