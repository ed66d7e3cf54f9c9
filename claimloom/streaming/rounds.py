"""Rounds as micro-batches: files of new papers or claims arrive, keyed tables follow.

State is a table of versions in a folder; a batch writes the next version, named by its batch id, and then points to it.
A batch that is run again after a failure writes the same version again, so the table sees each batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimloom.functions.grading import stance
from claimloom.functions.text import link_key
from claimloom.operators.memo import last_wins, upsert


class VersionedTable:
    """A keyed table kept as versions ``<path>/v=<n>``; the greatest complete one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = [s.getPath() for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done if p.getName().startswith("v="))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version (older than ``before``), or an empty table."""
        v = [n for n in self._versions() if before is None or n < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


def keep_upserted(stream: DataFrame, table: VersionedTable, key: str, sequence: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Merge a stream of rows into a keyed table, the greatest ``sequence`` of a batch winning; ``then`` gets each batch's
    new rows and number (the rest of a round)."""

    def merge(batch: DataFrame, n: int) -> None:
        rows = last_wins(batch, key, sequence).select(*table.schema.fieldNames())
        table.write(upsert(table.read(before=n), rows, key), n)
        if then:
            then(rows, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stance_counts(claims: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of stances for each edge and hour of arrival (column at), as a streaming aggregation with a watermark."""
    c = claims.withWatermark("at", late).withColumn("key", link_key(F.col("subject_concept"), F.col("relation_norm"), F.col("object_concept")))
    return c.groupBy(F.window("at", "1 hour").alias("hour"), "key").agg(F.count("*").alias("claims"), F.max(stance()).alias("stance"))
