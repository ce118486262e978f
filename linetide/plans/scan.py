"""The whole scan as one plan: entries, cascade, languages, contents, lines, report.

The path stage works on entries alone; contents are read for the files that are left, first
the heads of the few that a shebang may name, then the whole of those with a language.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.languages import Registry
from ..functions.lines import classify
from ..functions.reports import Report, build, unique_contents
from ..functions.shebangs import HEAD, sniffable, with_path_language, with_shebang_language
from ..operators.cascade import Rules, decide, display, entry_columns, own_reasons
from ..operators.ignore_files import rules_of
from ..sources import git, trees


@dataclass
class Options:
    """What a scan does."""

    rules: Rules = field(default_factory=Rules)
    extensions: set[str] = field(default_factory=set)
    languages: set[str] = field(default_factory=set)
    registry: Registry = field(default_factory=Registry.builtin)
    tracked: bool = False
    git_objects: bool = False
    dedup: bool = False
    follow_symlinks: bool = False
    by_file: bool = False


@dataclass
class Scan:
    """Counted files, exclusions, and every decision (path, is_dir, reason, detail)."""

    files: DataFrame
    excluded: DataFrame
    decisions: DataFrame
    warnings: DataFrame

    def report(self, by_file: bool = False) -> Report:
        return build(self.files, self.excluded, by_file)


def once_each(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files reached by several roots: the first root's stays; the others, in order of root and walk, are returned second."""
    order = Window.partitionBy("abs").orderBy("root", F.split("rel", "/"))
    ranked = candidates.withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def select_candidates(candidates: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Applies the filters on paths: extensions, and languages known by path; returns kept rows with language and to_sniff, and skipped ones."""
    base = F.substring_index("abs", "/", -1)
    out = with_path_language(candidates, "abs", options.registry)
    ext = F.lower(F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise(""))
    by_ext = ~ext.isin(*sorted(options.extensions)) if options.extensions else F.lit(False)
    by_lang = F.col("language").isNotNull() & ~F.lower("language").isin(*sorted(options.languages)) if options.languages else F.lit(False)
    out = out.withColumn("to_sniff", F.col("language").isNull() & sniffable(base))
    reason = F.when(by_ext, "extension").when(by_lang, "language").when(F.col("language").isNull() & ~F.col("to_sniff"), "unknown")
    detail = (
        F.when(by_ext, "extension not selected by --ext")
        .when(by_lang, F.concat(F.lit("language "), F.col("language"), F.lit(" not selected by --lang")))
        .when(F.col("language").isNull() & ~F.col("to_sniff"), "unknown language")
    )
    out = out.withColumn("reason", reason).withColumn("detail", detail)
    return out.where("reason is null").drop("reason", "detail"), out.where("reason is not null")


def count_files(files: DataFrame, options: Options, read: Callable[[DataFrame, int | None], DataFrame], hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted rows, skipped rows and warnings of candidates with path, language and to_sniff.

    ``read(rows, most)`` adds content and read_error; it is called for the heads of files of unknown name, and for the contents of
    files with a language.
    """
    none = F.lit(None).cast("string")
    heads = hold(read(files.where("to_sniff").drop("language", "to_sniff"), HEAD))
    failed_heads = heads.where("content is null")
    sniffed = with_shebang_language(heads.where("content is not null"), "content", options.registry).drop("content", "read_error")
    wanted = F.lower("language").isin(*sorted(options.languages)) if options.languages else F.lit(True)
    columns = [c for c in files.columns if c not in ("language", "to_sniff")]
    unknown = sniffed.where("language is null").withColumn("reason", F.lit("unknown")).withColumn("detail", F.lit("unknown language"))
    unwanted = sniffed.where(F.col("language").isNotNull() & ~wanted).withColumn("reason", F.lit("language")).withColumn("detail", F.concat(F.lit("language "), F.col("language"), F.lit(" not selected by --lang")))
    known = files.where("language is not null").select(*columns, "language").union(sniffed.where(F.col("language").isNotNull() & wanted).select(*columns, "language"))
    bodies = read(known, None)
    failed = bodies.where("content is null")
    bodies = bodies.where("content is not null").drop("read_error")
    if options.dedup:
        bodies = bodies.withColumn("sha256", F.sha2("content", 256))
    counted = hold(classify(bodies, "content", "language", options.registry, [c for c in bodies.columns if c != "content"]))
    binary = counted.where("is_binary")
    counted = counted.where("not is_binary").drop("is_binary")
    skipped = unknown.select("path", "reason", "detail").union(unwanted.select("path", "reason", "detail"))
    if options.dedup:
        marked = unique_contents(counted)
        copies = marked.where("duplicate_of is not null")
        skipped = skipped.union(copies.select("path", F.lit("duplicate").alias("reason"), F.concat(F.lit("duplicate of "), F.col("duplicate_of")).alias("detail")))
        counted = marked.where("duplicate_of is null").drop("duplicate_of", "sha256")
    warnings = binary.select("path", F.concat(F.lit("skipping binary file "), F.col("path")).alias("warning"))
    for bad in (failed_heads, failed):
        warnings = warnings.union(bad.select("path", F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.coalesce("read_error", none)).alias("warning")))
    return counted, skipped, warnings


def scan_entries(entries: DataFrame, ignore_texts: DataFrame | None, options: Options, read, tracked: DataFrame | None = None, overlap: bool = False, single: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scan:
    """A scan of listed entries (root, prefix, abs, rel, kind), whatever they were listed from.

    ``single`` are roots that are files themselves (root, prefix, abs, rel, path): the rules on paths pass them by; only tracking,
    repetition, extension, language and binary contents apply to them.  ``hold`` may keep what several results are made of.
    """
    listed = entry_columns(entries.where(F.col("kind").isin("dir", "file", "symlink", "other")))
    rules = rules_of(ignore_texts, ["root", "dir"]) if ignore_texts is not None and options.rules.gitignore else None
    kept, decisions = decide(hold(own_reasons(listed, options.rules, rules, tracked)))
    files = kept.withColumn("path", display(F.col("prefix"), F.col("rel"))).select("root", "prefix", "abs", "rel", "path")
    log = decisions.where("reason <> 'special'").withColumn("path", display(F.col("prefix"), F.col("rel")))
    excluded = log.where("detector is not null").select("path", "detector")
    trace = log.select("path", "is_dir", "reason", "detail")
    no = F.lit(False).alias("is_dir")
    if single is not None:
        if tracked is not None:
            known = tracked.select("root", "rel").distinct()
            trace = trace.union(single.join(known, ["root", "rel"], "left_anti").select("path", no, F.lit("untracked").alias("reason"), F.lit("not tracked by git").alias("detail")))
            single = single.join(known, ["root", "rel"], "left_semi").select(*files.columns)
        files = files.union(single.select(*files.columns))
    if overlap:
        files, again = once_each(files)
        trace = trace.union(again.select("path", no, F.lit("seen").alias("reason"), F.lit("already counted via another root").alias("detail")))
    chosen, skipped = select_candidates(files, options)
    counted, more, warnings = count_files(hold(chosen), options, read, hold)
    trace = trace.union(skipped.select("path", no, "reason", "detail")).union(more.select("path", no, "reason", "detail"))
    unreadable = entries.where(F.col("kind").isin("unreadable", "broken")).withColumn("path", display(F.col("prefix"), F.col("rel")))
    warnings = warnings.union(unreadable.select("path", F.concat(F.when(F.col("kind") == "broken", "broken symlink ").otherwise("cannot read directory "), F.col("path"), F.lit(": "), F.col("error"))))
    return Scan(counted.select("language", "path", "lines", "blank", "comment", "code"), excluded, trace, warnings)


def scan_paths(spark: SparkSession, paths: list[str], options: Options) -> Scan:
    """A scan of directories and files as given on a command line."""
    roots: list[tuple[int, str, str]] = []
    single: list[tuple[int, str, str]] = []
    for k, given in enumerate(paths):
        top = os.path.abspath(given)
        if not os.path.exists(top):
            raise FileNotFoundError(f"cannot read {given}: no such file or directory")
        prefix = os.path.normpath(given).replace(os.sep, "/")
        prefix = "" if prefix == "." else prefix
        (roots if os.path.isdir(top) else single).append((k, prefix, top))
    tracked = None
    if options.tracked or options.git_objects:
        tracked = git.tracked_files(spark, [(k, top if (k, p, top) in roots else os.path.dirname(top)) for k, p, top in [*roots, *single]], options.git_objects)
    if options.follow_symlinks:
        entries = trees.follow_trees(spark, roots, _driver_skip(options))
    elif roots:
        entries = trees.list_trees(spark, roots)
    else:
        entries = spark.createDataFrame([], trees.ENTRY)
    entries = entries.persist()
    texts = trees.ignore_file_texts(entries) if options.rules.gitignore else None
    directories = {k: top if os.path.isdir(top) else os.path.dirname(top) for k, _, top in [*roots, *single]}

    def read(files: DataFrame, most: int | None) -> DataFrame:
        if not options.git_objects:
            return trees.read_contents(files, most=most)
        oids = git.clean_objects(tracked)
        named = files.join(oids, ["root", "rel"], "left").select(*files.columns, "oid")
        blobs = git.read_blobs(named.where("oid is not null"), directories)
        if most is not None:
            blobs = blobs.withColumn("content", F.substring("content", 1, most))
        back = trees.read_contents(blobs.where("content is null").drop("content", "read_error", "oid"), most=most)
        plain = trees.read_contents(named.where("oid is null").drop("oid"), most=most)
        return blobs.where("content is not null").drop("oid").unionByName(back).unionByName(plain)

    files = spark.createDataFrame([(k, p, top, os.path.basename(top), p) for k, p, top in single], "root int, prefix string, abs string, rel string, path string") if single else None
    return scan_entries(entries, texts, options, read, tracked, len(paths) > 1 or options.follow_symlinks, files, lambda df: df.persist())


def _driver_skip(options: Options):
    """Which directories a walk that follows links does not enter: those that no later rule could bring back."""
    rules = options.rules

    def skip(name: str, rel: str) -> bool:
        return name in (".git", ".hg", ".svn", ".bzr") or (not rules.hidden and name.startswith(".")) or rules.exclude.matched_by(rel) is not None

    return skip
