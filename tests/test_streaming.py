from pyspark.sql import types as T

from claimloom.streaming.rounds import VersionedTable, keep_upserted, stance_counts

SCHEMA = T.StructType([T.StructField("pmid", T.StringType()), T.StructField("title", T.StringType()), T.StructField("seq", T.LongType())])


def test_batches_merge_once(spark, tmp_path):
    src, table = f"file://{tmp_path}/in", VersionedTable(spark, f"file://{tmp_path}/papers", SCHEMA)
    seen = []
    for rows in ([("p1", "old", 1), ("p1", "new", 2), ("p2", "x", 1)], [("p2", "y", 3), ("p3", "z", 1)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        keep_upserted(stream, table, "pmid", "seq", f"file://{tmp_path}/check", lambda df, n: seen.append((n, df.count()))).awaitTermination()
    assert {(r.pmid, r.title) for r in table.read().collect()} == {("p1", "new"), ("p2", "y"), ("p3", "z")}
    assert seen == [(0, 2), (1, 2)] and table.read(before=0).count() == 0


def test_windowed_stances(spark, tmp_path):
    src, schema = f"file://{tmp_path}/claims", "at timestamp, subject_concept string, relation_norm string, object_concept string"
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' AS at, 'a' AS subject_concept, 'increases' AS relation_norm, 'b' AS object_concept UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'a', 'increases', 'b'").write.parquet(src)
    q = stance_counts(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("stances").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.key, r.claims, r.stance) for r in spark.table("stances").collect()] == [("a|increases|b", 2, "up")]
