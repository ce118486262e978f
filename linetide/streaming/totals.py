"""Running per-language totals of a stream of counted files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(files: DataFrame) -> DataFrame:
    """Counts per language of a stream of file rows (language, lines, blank, comment, code); for complete or update output."""
    return files.groupBy("language").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("lines", "blank", "comment", "code")))
