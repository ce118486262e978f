"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import replaced, written


def _least(edges: DataFrame) -> DataFrame:
    """For each ``u`` the least of itself and its neighbours, ``m``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``, any order, repeats and loops allowed).

    ``root`` is the least node of the component.  Each round keeps at most as many edges as
    there are and is written to the shared folder in place of the one before; no node's neighbours are gathered in one row,
    so a node with very many edges costs a skewed join that Spark splits.  Null ends are dropped.
    """
    now = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u is not null and v is not null").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = _mark(now)
        if mark == before or mark[0] == 0:
            return _roots(now)
        before = mark
        both = now.where("u <> v").select("u", "v").union(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).union(now.where("u = v").select("u", "v"))
        large = both.join(_least(both), "u").where("v > u or v = u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.union(_least(both).select("u", F.col("m").alias("v"))).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(_least(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(_least(down).select("u", F.col("m").alias("v")))
        now = replaced(now, small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().select("v", "u"), "edges")
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return int(r["n"]), int(r["s"] or 0)


def _roots(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
