"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone
    (tests) one of this machine is set."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it again: lineage ends here, and a lost executor
    costs no more than a re-read. by: a column of which each value has a folder of its own, so that readers who want
    some values leave the others' files alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, *by: str, name: str = "t", to: str | None = None) -> str:
    """Write ``df`` as a table of ``n`` buckets by some columns, in the shared folder, and return its name: groupings and joins on those columns read
    it without a shuffle, and rows rest on disk as compressed columns. to: a table of the same buckets, to which the rows are added."""
    spark, writers = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    at = to or f"claimloom_{name}_{uuid.uuid4().hex}"
    path, before = f"{shared_dir(spark)}/{at}", spark.conf.get(writers)
    spark.conf.set(writers, str(n))  # a file open for each bucket, so that rows are not sorted (and spilled) first
    try:
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *by).mode("append").saveAsTable(at)
    finally:
        spark.conf.set(writers, before)
    if to is None:
        _WRITTEN.append(path)
    return at


def drop(spark: SparkSession, name: str) -> None:
    """Delete a table of ``bucketed`` that nothing reads any more."""
    path = next(p for p in _WRITTEN if p.endswith(f"/{name}"))
    spark.sql(f"DROP TABLE {name}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.remove(path)


def mark() -> int:
    """A point in the list of scratch tables, for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the scratch tables written since a mark, but for those that the frames in ``keep`` read. For callers who
    know that nothing lazy still reads them, such as between the stages of a pipeline."""
    held = {f for df in keep for f in df.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in _WRITTEN[since:]:
        name = path.rsplit("/", 1)[1]
        if any(f"/{name}/" in f for f in held):
            left.append(path)
        else:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    _WRITTEN[since:] = left


def numbered(df: DataFrame, *order: str | Column, name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 in an order, without sorting them in one task: ranges are sorted apart, and each range's
    numbers start after the rows before it. Ties of the order are numbered in no particular order."""
    spark = df.sparkSession
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("__part", F.shiftright("__id", 33)), "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())  # one row a partition
    starts, at = [], 0
    for part, size in sizes:
        starts.append((part, at))
        at += size
    first = spark.createDataFrame(starts, "__part long, __start long")
    return ranged.join(F.broadcast(first), "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__id", "__start")
