import random

from claimloom.sources.scratch import mark, materialize, numbered, release


def test_numbering_is_the_order(spark):
    rows = [(random.Random(1).randrange(10**6) + i, str(i)) for i in range(500)]
    random.Random(2).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "a long, b string").repartition(7), "a", "b", parts=5).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(500))
    assert numbered(spark.createDataFrame([], "a long"), "a").count() == 0


def test_release_keeps_what_is_read(spark):
    before = mark()
    a, b = materialize(spark.range(5), "a"), materialize(spark.range(6), "b")
    release(spark, before, keep=[b])
    assert b.count() == 6
    try:
        a.count()
        raise AssertionError("the table is still there")
    except Exception as e:  # noqa: BLE001
        assert "still there" not in str(e)
