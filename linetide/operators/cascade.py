"""The ordered cascade of skip rules over the entries of scanned trees.

Every entry gets its own reason by the first rule that holds for it.  A directory that is skipped takes
everything below with it: what counts for an entry is the shallowest skipped directory above it, so
the rules can be worked out for all entries at once, and rules that lie in a skipped directory only reach
entries that are skipped anyway.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import PatternSet
from ..functions.reports import go_quote
from .detectors import Detectors
from .ignore_files import ancestors, ignored

# Directories of version control systems.
VCS = (".git", ".hg", ".svn", ".bzr")


@dataclass
class Rules:
    """Which rules are on."""

    exclude: PatternSet = field(default_factory=PatternSet)
    include: PatternSet = field(default_factory=PatternSet)
    hidden: bool = False
    gitignore: bool = True
    detectors: Detectors | None = field(default_factory=Detectors)


def display(prefix: Column, rel: Column) -> Column:
    """A path as it is reported: below its root's prefix; the root ``.`` has none."""
    return F.when(prefix == "", F.when(rel == "", ".").otherwise(rel)).when(rel == "", prefix).otherwise(F.concat(prefix, F.lit("/"), rel))


def entry_columns(entries: DataFrame) -> DataFrame:
    """Adds name, parent, depth and is_dir to entries of root, prefix, rel and kind (dir, file, symlink or other)."""
    cut = F.expr("length(rel) - length(substring_index(rel, '/', -1)) - 1")
    return (
        entries.withColumn("name", F.substring_index("rel", "/", -1))
        .withColumn("parent", F.when(cut > 0, F.expr("substring(rel, 1, length(rel) - length(substring_index(rel, '/', -1)) - 1)")).otherwise(""))
        .withColumn("depth", F.size(F.split("rel", "/")))
        .withColumn("is_dir", F.col("kind") == "dir")
    )


def own_reasons(entries: DataFrame, rules: Rules, ignore_rules: DataFrame | None = None, tracked: DataFrame | None = None) -> DataFrame:
    """``entries`` with reason (null: kept by its own rules), detail and detector.

    ``ignore_rules`` has root, dir and parsed rules; ``tracked`` has root and rel of the tracked files.
    """
    out = entries
    excluded = rules.exclude.column(F.col("rel"))
    if tracked is not None:
        files = tracked.select("root", "rel").distinct()
        dirs = files.select("root", F.explode(ancestors(F.col("rel"))).alias("up")).select("root", F.col("up.dir").alias("rel")).where("rel <> ''").distinct()
        known = files.withColumn("_dir", F.lit(False)).union(dirs.withColumn("_dir", F.lit(True))).withColumn("_tracked", F.lit(True))
        out = out.join(known.withColumnRenamed("_dir", "is_dir"), ["root", "rel", "is_dir"], "left")
    else:
        out = out.withColumn("_tracked", F.lit(True))
    if rules.detectors is not None:
        out = out.join(rules.detectors.excluded(entries).withColumnRenamed("detector", "_smart"), ["root", "rel"], "left")
        out = out.join(rules.detectors.self_excluded(entries).withColumnRenamed("detector", "_self"), ["root", "rel"], "left")
    else:
        out = out.withColumn("_smart", F.lit(None).cast("string")).withColumn("_self", F.lit(None).cast("string"))
    if rules.gitignore and ignore_rules is not None:
        out = out.join(ignored(entries, ignore_rules), ["root", "rel"], "left")
    else:
        out = out.withColumn("ignored_by", F.lit(None).cast("string"))
    is_dir, name = F.col("is_dir"), F.col("name")
    out = out.withColumn("_excluded", excluded).withColumn("_included", rules.include.column(F.col("rel")) if rules.include else F.lit(""))
    found = [
        (F.col("kind") == "symlink", "symlink", F.lit("symlink; --follow-symlinks off"), None),
        (is_dir & name.isin(*VCS), "vcs", F.lit("vcs metadata"), None),
        (F.lit(not rules.hidden) & name.startswith("."), "hidden", F.lit("hidden; use --hidden to count"), None),
        (F.col("_excluded").isNotNull(), "excluded", F.concat(F.lit("excluded by pattern "), go_quote(F.col("_excluded"))), None),
        (F.col("_tracked").isNull(), "untracked", F.when(is_dir, "no git-tracked files").otherwise("not tracked by git"), None),
        (is_dir & F.col("_smart").isNotNull(), "smart", F.concat(F.lit("smart: "), F.col("_smart")), F.col("_smart")),
        (F.col("ignored_by").isNotNull(), "gitignored", F.concat(F.lit("gitignored by "), F.col("ignored_by")), None),
        (is_dir & F.col("_self").isNotNull(), "smart", F.concat(F.lit("smart: "), F.col("_self")), F.col("_self")),
        (F.col("kind") == "other", "special", F.lit("not a regular file"), None),
        (~is_dir & F.col("_included").isNull(), "not included", F.lit("no include pattern matches"), None),
    ]
    none = F.lit(None).cast("string")
    choose = F.struct(none.alias("reason"), none.alias("detail"), none.alias("detector"))
    for holds, reason, detail, detector in reversed(found):
        choose = F.when(holds, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"), (none if detector is None else detector).alias("detector"))).otherwise(choose)
    return out.withColumn("_why", choose).select(*entries.columns, "_why.reason", "_why.detail", "_why.detector")


def decide(reasoned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept files, and the decisions: entries skipped by their own rule and by no directory above them.

    Only directories are unfolded into those above them, and only the ones that hold entries.
    """
    skipped = reasoned.where(F.col("is_dir") & F.col("reason").isNotNull()).select("root", F.col("rel").alias("dir"))
    parents = reasoned.select("root", "parent").distinct()
    above = parents.select("root", "parent", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/"))), lambda n: F.array_join(F.slice(F.split("parent", "/"), F.lit(1), n), "/"))).alias("dir"))
    gone = above.join(skipped, ["root", "dir"]).select("root", "parent").distinct()
    reached = reasoned.join(gone, ["root", "parent"], "left_anti")
    kept = reached.where(F.col("reason").isNull() & ~F.col("is_dir"))
    return kept, reached.where(F.col("reason").isNotNull())
