import random
import uuid
from datetime import datetime, timedelta

from claimloom.streaming.counters import EVENT, KINDS, counted, follow, latest, link_counters


def events(seed=1):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(12)}", rng.randrange(1, 6), rng.choice(KINDS), rng.choice([True, False, None]), datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(160)]


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rows, src, name = events(), f"file://{tmp_path}/in", f"counters-{uuid.uuid4().hex}"
    want = {tuple(r) for r in counted(spark.createDataFrame(rows, EVENT)).collect()}
    assert any(r[3] for r in want) and any(r[1] for r in want)
    for part in (rows[:70], rows[70:], rows[20:50], rows[::-1]):  # two batches, then some events again, then all in another order
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        query, folder = follow(link_counters(spark.readStream.schema(EVENT).parquet(src)), name)
        query.awaitTermination()
        if part is not rows[:70]:
            got = {tuple(r)[:4] for r in latest(spark, folder).collect()}
    assert got == want and not latest(spark, folder).where("expired").count()


def test_idle_keys_expire(spark, tmp_path):
    at, src, name = datetime(2024, 1, 1), f"file://{tmp_path}/in", f"counters-{uuid.uuid4().hex}"
    for part in ([("old", 1, "targeted", None, at)], [("new", 2, "searched", True, at + timedelta(hours=9))], [("new", 3, "searched", True, at + timedelta(hours=9))]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        query, folder = follow(link_counters(spark.readStream.schema(EVENT).parquet(src), idle_ms=3_600_000, late="1 minute"), name)
        query.awaitTermination()
    got = {r.key: tuple(r)[1:] for r in latest(spark, folder).collect()}
    assert got["old"] == (1, 0, False, True) and got["new"] == (0, 2, True, False)


def test_rounds_without_a_number_and_no_python_at_the_keys(spark, tmp_path):
    rows = [(k and f"k{k}", None if n % 3 == 0 else n - 4, KINDS[(n + i) % 3], n % 2 == 0, datetime(2024, 1, 1)) for i, k in enumerate((1, 2, 3, None)) for n in range(i, 9)]
    rows += [("only", 1, "searched", False, datetime(2024, 1, 1)), ("odd", 1, "other", True, datetime(2024, 1, 1)), ("odd", 2, None, None, datetime(2024, 1, 1))]
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(src)
    stream = link_counters(spark.readStream.schema(EVENT).parquet(src))
    assert "InPandas" not in stream._jdf.queryExecution().analyzed().toString()  # Python at each key: 407 task seconds for 9,000 keys
    query, folder = follow(stream, f"counters-{uuid.uuid4().hex}")
    query.awaitTermination()
    want = {tuple(r) for r in counted(spark.createDataFrame(rows, EVENT)).collect()}
    assert {tuple(r)[:4] for r in latest(spark, folder).collect()} == want and ("only", 0, 0, False) in want


def test_the_processor_counts_as_the_batch(spark, tmp_path):
    rows, src, name = events(2), f"file://{tmp_path}/in", f"counters-{uuid.uuid4().hex}"
    for part in (rows[:90], rows[60:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(src)
        query, folder = follow(link_counters(spark.readStream.schema(EVENT).parquet(src), idle_ms=10**9), name)
        query.awaitTermination()
    assert {tuple(r)[:4] for r in latest(spark, folder).collect()} == {tuple(r) for r in counted(spark.createDataFrame(rows, EVENT)).collect()}
