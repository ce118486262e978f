"""Sends the package's code to the Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package as a zip file to the session's executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="linetide-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = folder / "linetide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
