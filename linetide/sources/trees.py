"""File trees: a data source that lists them, and a reader of contents.

Paths must be visible to the executors (shared storage on a cluster).  A tree is listed from its
directories in parallel, found breadth first; directories of version control systems are listed as
entries but not entered, as no option ever enters them.
"""

from __future__ import annotations

import os
import stat
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "root int, prefix string, abs string, rel string, kind string, size bigint, error string"
_STAY_OUT = (".git", ".hg", ".svn", ".bzr")
#: Tasks that a listing is dealt out to, if the trees have so many directories.
TARGET = 256


class _Below(InputPartition):
    def __init__(self, root: int, prefix: str, top: str, rel: str, deep: bool):
        self.root, self.prefix, self.top, self.rel, self.deep = root, prefix, top, rel, deep


def kind_of(mode: int) -> str:
    """dir, file, symlink or other."""
    return "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "symlink" if stat.S_ISLNK(mode) else "other"


def _rows(part: _Below):
    todo = [part.rel]
    while todo:
        rel = todo.pop()
        place = os.path.join(part.top, rel) if rel else part.top
        try:
            names = sorted(os.listdir(place), key=os.fsencode)
        except OSError as e:
            yield part.root, part.prefix, place, rel, "unreadable", None, e.strerror or str(e)
            continue
        for name in names:
            own = f"{rel}/{name}" if rel else name
            try:
                found = os.lstat(os.path.join(place, name))
            except OSError:
                continue
            kind = kind_of(found.st_mode)
            yield part.root, part.prefix, os.path.join(place, name), own, kind, found.st_size if kind == "file" else None, None
            if kind == "dir" and name not in _STAY_OUT and part.deep:
                todo.append(own)


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[tuple[int, str, str]]):
        self.roots = roots

    def partitions(self):
        """Breadth first, until there are :data:`TARGET` directories to list with all that is below them."""
        out, todo = [], deque((k, prefix, top, "") for k, prefix, top in self.roots)
        while todo and len(todo) < TARGET:
            k, prefix, top, rel = todo.popleft()
            out.append(_Below(k, prefix, top, rel, False))
            place = os.path.join(top, rel) if rel else top
            try:
                with os.scandir(place) as found:
                    names = sorted(e.name for e in found if e.name not in _STAY_OUT and e.is_dir(follow_symlinks=False))
            except OSError:
                continue
            todo.extend((k, prefix, top, f"{rel}/{n}" if rel else n) for n in names)
        return out + [_Below(*x, True) for x in todo]

    def read(self, partition):
        yield from _rows(partition)


class TreeSource(DataSource):
    """Lists directory trees: ``format("linetide_tree").option("roots", json list of [number, prefix, path])``."""

    @classmethod
    def name(cls) -> str:
        return "linetide_tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema):
        import json

        return _TreeReader([tuple(x) for x in json.loads(self.options["roots"])])


def list_trees(spark: SparkSession, roots: list[tuple[int, str, str]]) -> DataFrame:
    """Entries below each ``(number, prefix, absolute path)``: those of every directory, named and hidden alike."""
    import json

    spark.dataSource.register(TreeSource)
    return spark.read.format("linetide_tree").option("roots", json.dumps(roots)).load()


def follow_trees(spark: SparkSession, roots: list[tuple[int, str, str]], skip) -> DataFrame:
    """Entries with symbolic links followed: each resolved directory is entered once, in the order of a serial walk.

    What a walk enters depends on what it entered before, so the driver walks; ``skip(name, rel)`` tells which
    directories are not entered.  Links have the kind of what they lead to, broken ones are ``broken``.
    """
    seen: set[str] = set()
    rows = []

    def entered(k: int, prefix: str, top: str, rel: str):
        """What is in a directory that was not entered before; adds its row and gives the directories in it, one by one."""
        place = os.path.join(top, rel) if rel else top
        real = os.path.realpath(place)
        if real in seen:
            return
        seen.add(real)
        try:
            names = sorted(os.listdir(place), key=os.fsencode)
        except OSError as e:
            rows.append((k, prefix, place, rel, "unreadable", None, e.strerror or str(e)))
            return
        for name in names:
            own = f"{rel}/{name}" if rel else name
            path = os.path.join(place, name)
            try:
                found = os.stat(path)
            except OSError as e:
                rows.append((k, prefix, path, own, "broken", None, e.strerror or str(e)))
                continue
            kind = kind_of(found.st_mode)
            rows.append((k, prefix, path, own, kind, found.st_size if kind == "file" else None, None))
            if kind == "dir" and not skip(name, own):
                yield own

    for k, prefix, top in roots:
        open_ = [entered(k, prefix, top, "")]
        while open_:
            rel = next(open_[-1], None)
            if rel is None:
                open_.pop()
            else:
                open_.append(entered(k, prefix, top, rel))
    return spark.createDataFrame(rows, ENTRY)


def read_contents(files: DataFrame, path: str = "abs", into: str = "content", most: int | None = None) -> DataFrame:
    """Adds the bytes of each path (the first ``most`` of them) and an error where it could not be read."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [*files.columns, into, "read_error"]
    at = files.columns.index(path)
    schema = T.StructType([*files.schema.fields, T.StructField(into, T.BinaryType()), T.StructField("read_error", T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                body = error = None
                try:
                    with open(row.column(at)[0].as_py(), "rb") as f:
                        body = f.read() if most is None else f.read(most)
                except OSError as e:
                    error = e.strerror or str(e)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary()), pa.array([error], pa.string())], names)

    return files.mapInArrow(run, schema)


def ignore_file_texts(entries: DataFrame) -> DataFrame:
    """``root, dir, content`` of the regular files named .gitignore among the entries."""
    own = entries.where((F.substring_index("rel", "/", -1) == ".gitignore") & (F.col("kind") == "file"))
    cut = F.expr("substring(rel, 1, greatest(length(rel) - length('.gitignore') - 1, 0))")
    return read_contents(own.select("root", cut.alias("dir"), "abs")).where("content is not null").select("root", "dir", "content")
