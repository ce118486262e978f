"""Git as a source: tracked files, the object ids of clean ones, and blob contents."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKED = "root int, rel string, mode string, oid string, stage int, dirty boolean"


def _git(directory: str, *arguments: str) -> list[bytes]:
    done = subprocess.run(["git", "-C", directory, *arguments], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]} in {directory}: {done.stderr.decode(errors='replace').strip()}")
    return [x for x in done.stdout.split(b"\0") if x]


def tracked_files(spark: SparkSession, roots: list[tuple[int, str]], objects: bool = False) -> DataFrame:
    """``root, rel`` of the tracked files below each root's directory; with ``objects`` also the object ids that stand for them.

    The index is read by git where the driver runs; a directory outside any repository is an error.  An object stands for
    a file only at stage 0, as a regular file, and if the working tree has not changed it.
    """
    rows = []
    for k, directory in roots:
        if not objects:
            rows += [(k, x.decode("utf-8", "surrogateescape"), None, None, None, None) for x in _git(directory, "ls-files", "-z")]
            continue
        changed = set(_git(directory, "ls-files", "-m", "-d", "-z"))
        for x in _git(directory, "ls-files", "-s", "-z"):
            facts, _, name = x.partition(b"\t")
            mode, oid, stage = facts.decode().split()
            rows.append((k, name.decode("utf-8", "surrogateescape"), mode, oid, int(stage), name in changed))
    return spark.createDataFrame(rows, TRACKED)


def clean_objects(tracked: DataFrame) -> DataFrame:
    """``root, rel, oid`` of the index entries whose object can be read in place of the file: the index less what has changed."""
    usable = tracked.where((F.col("stage") == 0) & F.col("mode").startswith("100"))
    return usable.join(tracked.where("dirty").select("root", "rel"), ["root", "rel"], "left_anti").select("root", "rel", "oid")


def read_blobs(files: DataFrame, directories: dict[int, str]) -> DataFrame:
    """Adds content and read_error to rows with root and oid: one ``git cat-file --batch`` per task and root, asked in order."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [*files.columns, "content", "read_error"]
    at_root, at_oid = files.columns.index("root"), files.columns.index("oid")
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])

    def run(batches):
        open_: dict[int, subprocess.Popen] = {}

        def read(root: int, oid: str) -> bytes:
            if root not in open_:
                open_[root] = subprocess.Popen(["git", "-C", directories[root], "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
            p = open_[root]
            p.stdin.write(f"{oid}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3 or head[1] != b"blob":
                raise OSError(f"no blob {oid}")
            body = p.stdout.read(int(head[2]))
            p.stdout.read(1)
            return body

        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    body = error = None
                    try:
                        body = read(row.column(at_root)[0].as_py(), row.column(at_oid)[0].as_py())
                    except OSError as e:
                        error = str(e)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary()), pa.array([error], pa.string())], names)
        finally:
            for p in open_.values():
                p.stdin.close()
                p.stdout.close()
                p.wait()

    return files.mapInArrow(run, schema)
