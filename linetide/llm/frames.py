"""Helpers shared by the operators: Arrow maps, shared storage, bounded memo tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows turned into Python objects at a time, so that long texts are not all held twice.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data directory, by a path only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing and the master is local a temporary folder is made; a cluster without it is refused, as
    its executors would each write to a disk of their own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="linetide-")
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Folders written by this driver and not removed yet.
_PATHS: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors; the files go
    when :func:`settled` or :func:`replaced` says so, or the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linetide-{label}-{uuid.uuid4().hex}"
    if not _PATHS:
        atexit.register(remove, _PATHS)
    _PATHS[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._linetide_path = path
    return back


def settled(make: Callable[[], DataFrame], label: str, old: DataFrame | None = None) -> DataFrame:
    """The frame that ``make`` returns, written; what was written on the way to it is removed, and so is the written table ``old`` that it came from."""
    before = set(_PATHS) - ({old._linetide_path} if old is not None else set())
    out = written(make(), label)
    remove([p for p in _PATHS if p not in before and p != out._linetide_path])
    return out


def replaced(old: DataFrame | None, df: DataFrame, label: str) -> DataFrame:
    """``df`` written; then the table ``old``, which nothing but ``df`` was made of any more, is removed."""
    out = written(df, label)
    if old is not None:
        remove([old._linetide_path])
    return out


def remove(paths) -> None:
    """Deletes written folders; those of a session that has ended stay."""
    for path in list(paths):
        spark = _PATHS.pop(path, None)
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


#: Rows of one key from which the key is joined apart, and how many keys may have that many.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the facts of their keys: one row for each key, of which ``n`` tells how many rows have it.

    A key of very many rows would be one task of a shuffle.  Those with over a 10,000th of all rows (and over
    :data:`HOT_ROWS`) are at most :data:`HOT_KEYS`, so their facts are sent to all tasks; the others meet by a shuffle.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    if facts.where(often).isEmpty():
        return rows.join(facts.drop(n), keys)
    hot = F.broadcast(facts.where(often).drop(n))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(facts.where(often).select(*keys)), keys, "left_anti").join(facts.where(~often).drop(n), keys))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` by slices of a batch; ``make`` runs once in each task and returns the slice function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = step(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own; a null text is empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Memo(dict):
    """A dict that computes missing values, forgets all of them when it is full and never keeps long keys."""

    def __init__(self, compute: Callable, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Generations:
    """Values of keys, computed many at a time; of the keys not met lately the table forgets."""

    def __init__(self, compute: Callable[[list], list], most: int = 200_000, longest: int = 64):
        self.compute, self.most, self.longest = compute, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        """The value of each of some distinct keys."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        new = []
        for k, value in enumerate(out):
            if value is None:
                key = keys[k]
                value = old.get(key)
                if value is None:
                    new.append(k)
                else:
                    out[k] = young[key] = value
        for k, value in zip(new, self.compute([keys[k] for k in new]), strict=True):
            out[k] = value
            if type(keys[k]) is int or len(keys[k]) <= self.longest:
                young[keys[k]] = value
        if len(young) >= self.most:
            self.old, self.young = young, {}
        return out


#: What a Python worker keeps between tasks: the latest model only, with its kind and key.
_KEPT: list[tuple] = []


def kept(kind: str, key, build: Callable):
    """``build()``, once in a Python worker for as long as no other kind or key is asked for."""
    if not _KEPT or _KEPT[0][0] != (kind, key):
        _KEPT.clear()
        _KEPT.append(((kind, key), build()))
    return _KEPT[0][1]
