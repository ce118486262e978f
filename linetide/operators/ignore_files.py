"""Ignore files: rules of each directory's file, and which entries they ignore.

The last matching rule of a file decides; of the files from the root down the nearest one
with a matching rule has the last word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import BadGlob, java, rooted_regex
from ..functions.reports import go_quote

#: Bytes of a line from which an ignore file is read no further.
LONGEST = 64 * 1024
RULES = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("negate", T.BooleanType()), T.StructField("dir_only", T.BooleanType()), T.StructField("rooted", T.BooleanType()), T.StructField("regex", T.StringType())])


def parse_rules(content: str) -> list[dict]:
    """Rules of an ignore file; malformed globs never match and give no rule."""
    out: list[dict] = []
    for line in content.split("\n"):
        if len(line.encode("utf-8", "surrogateescape")) >= LONGEST:
            break
        line = line.removesuffix("\r")
        if line.startswith("#"):
            continue
        raw = line = line.rstrip(" \t")
        negate = line.startswith("!")
        line = line[negate:].removeprefix("\\!").removeprefix("\\#")
        dir_only = line.endswith("/")
        line = line.removesuffix("/")
        rooted = "/" in line
        line = line.removeprefix("/") if rooted else line
        if not line:
            continue
        try:
            core = rooted_regex(line.split("/"), False)
        except BadGlob:
            continue
        out.append({"ord": len(out), "raw": raw, "negate": negate, "dir_only": dir_only, "rooted": rooted, "regex": java(core)})
    return out


def rules_of(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys`` and one row per rule of each ignore file's text."""
    import pyarrow as pa

    source = files.select(*keys, F.col(content).cast("string").alias("_content"))
    schema = T.StructType([*source.schema.fields[: len(keys)], *RULES.fields])

    def run(batches):
        for batch in batches:
            rows = [(k, r) for k, text in enumerate(batch.column(len(keys)).to_pylist()) for r in parse_rules(text or "")]
            at = pa.array([k for k, _ in rows], pa.int64())
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[: len(keys)]] + [pa.array([r[f] for _, r in rows], t) for f, t in zip(RULES.fieldNames(), kinds, strict=True)], schema.fieldNames())

    return source.mapInArrow(run, schema)


def ancestors(rel: Column) -> Column:
    """The directories a path lies in, from the root (empty) down."""
    segments = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.struct(F.array_join(F.slice(segments, F.lit(1), n), "/").alias("dir"), n.alias("depth")))


#: Rules, and marked directories, up to which they are sent to all tasks.
FEW = 100_000


def sent_if_few(df: DataFrame, most: int = FEW) -> tuple[DataFrame, bool]:
    """``df`` kept, and marked for broadcast if it has at most ``most`` rows; whether it is."""
    kept = df.persist()
    few = kept.limit(most + 1).count() <= most
    return (F.broadcast(kept) if few else kept), few


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``root, rel, ignored_by`` of the ignored entries (columns root, rel, is_dir); rules have root, dir and :data:`RULES`.

    Each entry meets the rules of the directories it lies in.  Up to :data:`FEW` rules go to all tasks, so no entry is moved to meet
    them.  More rules are brought together for each directory that holds entries, and the entries meet those of their own
    directory: not even the rules of a root gather its entries in one task.
    """
    rules, few = sent_if_few(rules)
    own = entries.select("root", "rel", "is_dir")
    if few:
        below = own.select("*", F.explode(ancestors(F.col("rel"))).alias("up")).select("root", "rel", "is_dir", F.col("up.dir").alias("dir"), F.col("up.depth").alias("depth"))
        met = below.join(rules, ["root", "dir"])
    else:
        parent = F.expr("substring(rel, 1, greatest(length(rel) - length(substring_index(rel, '/', -1)) - 1, 0))")
        placed = own.withColumn("_parent", parent)
        above = placed.select("root", "_parent").distinct().select("root", "_parent", F.explode(ancestors(F.concat("_parent", F.when(F.col("_parent") == "", "").otherwise("/"), F.lit("x")))).alias("up"))
        above = above.select("root", "_parent", F.col("up.dir").alias("dir"), F.col("up.depth").alias("depth")).join(rules, ["root", "dir"])
        names = ["dir", "depth", *RULES.fieldNames()]
        gathered = above.groupBy("root", "_parent").agg(F.collect_list(F.struct(*names)).alias("_rules"))
        met = placed.join(gathered, ["root", "_parent"]).select("root", "rel", "is_dir", F.explode("_rules").alias("_rule")).select("root", "rel", "is_dir", "_rule.*")
    sub = F.when(F.col("dir") == "", F.col("rel")).otherwise(F.expr("substring(rel, length(dir) + 2)"))
    subject = F.when(F.col("rooted"), sub).otherwise(F.substring_index("rel", "/", -1))
    hit = met.withColumn("_subject", subject).where((~F.col("dir_only") | F.col("is_dir")) & F.expr("_subject rlike regex"))
    last = hit.groupBy("root", "rel").agg(F.max_by(F.struct("negate", "raw", "dir"), F.struct("depth", "ord")).alias("rule"))
    place = F.when(F.col("rule.dir") == "", ".gitignore").otherwise(F.concat(F.col("rule.dir"), F.lit("/.gitignore")))
    return last.where(~F.col("rule.negate")).select("root", "rel", F.concat(place, F.lit(": "), go_quote(F.col("rule.raw"))).alias("ignored_by"))
