"""Prepare a session for this package's Python functions: code on the executors, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")  # name, Spark's default, ours


def ship(spark: SparkSession) -> SparkSession:
    """Add a zip of the package to the session's Python files, once for each application, so that its functions run
    where it is not installed; and bound the bytes of Arrow batches, if the session has Spark's default: texts differ
    much in length, and a batch is held by the JVM and by Python at once."""
    if spark.conf.get(ARROW_BYTES[0], ARROW_BYTES[1]) == ARROW_BYTES[1]:
        spark.conf.set(ARROW_BYTES[0], ARROW_BYTES[2])
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="claimloom-ship-")) / "claimloom_package.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out))
        _SENT.add(app)
    return spark
