"""What a session needs before Python workers can run this library's functions."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark removes shuffle files at the end of each execution meanwhile."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_corvine_sent", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="corvine-")) / "corvine.zip"
    with zipfile.ZipFile(to, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(to))
    context._corvine_sent = True
