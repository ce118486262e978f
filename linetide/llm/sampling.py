"""Bounded samples of labelled rows, and the split that keeps rows out of learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written


def remainder(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def least_hashes(df: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """At most ``most`` distinct ``(id, group)`` of each group: those with the least hashes of their ids.

    Repeated rows count once, so neither their number nor their hash changes how many are drawn.  Only ids and groups are
    moved.  A group's number of distinct ids tells below which hash about twice as many lie as are wanted; what is
    left is bounded, and the hash of the last one wanted is found by an aggregate, not by ranking a group in one task.
    """
    rows = df.select(id_col, group, F.xxhash64(id_col).alias("mark"))
    share = (F.col("mark") / float(2**64)) + 0.5
    sizes = df.groupBy(group).agg(F.approx_count_distinct(id_col, 0.02).alias("n"))
    near = written(rows.join(sent(sizes, "groups", 10_000), group).where(share * F.col("n") <= 2.0 * most + 200).select(id_col, group, "mark").distinct(), "near")
    last = near.groupBy(group).agg(F.sort_array(F.collect_list("mark")).alias("marks")).select(group, F.get("marks", F.least(F.size("marks"), F.lit(most)) - 1).alias("last"))
    return near.join(sent(last, "last", 10_000), group).where(F.col("mark") <= F.col("last")).select(id_col, group)


def sent(df: DataFrame, label: str, most: int) -> DataFrame:
    """``df`` written and counted: marked for broadcast up to ``most`` rows, else left to a shuffle."""
    few = written(df, label)
    return F.broadcast(few) if few.count() <= most else few


def text_of(documents: DataFrame, sample: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """The rows of a sample with the column ``text`` of ``documents``: of several texts of a sampled row the least.

    A sample of up to ``most`` rows is sent to every executor so that no other text is moved; a larger one is joined by a
    shuffle.  Copies of a sampled row are dropped where they lie.
    """
    own = sample.columns
    return documents.select(*on, "text").join(sent(sample, "sample", most), on).groupBy(*own).agg(F.min("text").alias("text"))
