"""Source divergence audit: DuckDB over shards of (lang, term), sums and rankings merged by Spark.

Terms are the runs of letters (``[A-Za-z]`` and everything outside ASCII), only A-Z lower-cased. A language keeps the V
terms that at least ``LEAST_DOCS`` of its rows hold. For a group (lang, source), or a whole language, with N
occurrences of kept terms, a term's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares diverge by
f = floor((p - q)^2 / (p + q)). All arithmetic is on integers.

Method.

1. Each task counts the terms of its texts in SQL; common ones are added up over the task.
2. Shards by hash of (lang, term) sum these rows in SQL as they stream in, and keep the terms with enough documents; a
   term's rows are added up again and again, so many tasks don't make a shard grow.
3. N and V are summed by Spark and joined to the kept counts. Shards of the same kind give, in SQL, partial pair sums
   and their best terms of each source. Terms that a source lacks have one and the same share, so pairs are summed over the terms
   that both sources hold, as differences from those shares; the rest follows from the number of terms for each count.
4. Spark adds up the pair sums of all shards, merges the best terms and ranks.

Defined results: null text, lang and source are ''. Rows repeated under one doc_id are documents of their own. A language
without kept terms has pairs of value 0 and no term rows; one with one source has no pairs. Ties go by UTF-8 order of
the item. Very long texts are whole. An empty table gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.textbuf import tidy
from claimloom.sources.scratch import materialize

LEAST_DOCS, BEST_TERMS, SCALE = 10, 10, 1_000_000_000
FULL, COMMON = 1_000_000, 3  # rows of partial counts that a task holds before it adds them up; texts of a batch from which a term is held
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
FOLD = _FOLD.tobytes()


def folded(texts: pa.Array) -> pa.Array:
    """The texts with letters A-Z lower-cased and all other ASCII as blanks, so that terms stand between blanks."""
    t = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    data = t.buffers()[2]
    return pa.LargeStringArray.from_buffers(len(t), t.buffers()[1], pa.py_buffer(data.to_pybytes().translate(FOLD) if data is not None else b""), offset=t.offset)


def _database() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:")
    _run(con, "SET threads = 1; SET memory_limit = '500MB'; SET preserve_insertion_order = false")
    return con


def _run(con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Run to the end; the first number that comes back, such as the rows of an insertion."""
    rows = con.execute(sql).fetchall()
    return rows[0][0] if rows else 0


def _batches(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(50_000)


_COUNTS = "lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT"
_SUMMED = "SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY lang, term, source"


def _shorten(con: duckdb.DuckDBPyConnection) -> int:
    """Add up the rows of part; how many are left."""
    _run(con, f"CREATE TABLE short AS {_SUMMED}; DROP TABLE part; ALTER TABLE short RENAME TO part")
    return _run(con, "SELECT count(*) FROM part")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to the counts of terms and of texts that hold them. Terms that several texts of a batch hold are
    added up over the task, so that common ones make a row for each source of it; the others, mostly rare, go on as they are."""
    con = _database()
    _run(con, f"CREATE TABLE part ({_COUNTS})")
    rows = 0
    for batch in batches:
        seen = pa.table([pa.array(np.arange(batch.num_rows)), batch.column(0), batch.column(1), folded(batch.column(2))], ["row", "lang", "source", "text"])
        con.register("seen", seen)
        _run(con, """CREATE TABLE own AS SELECT lang, term, source, sum(n)::BIGINT AS n, count(*) AS docs FROM
            (SELECT row, term, count(*) AS n FROM (SELECT row, unnest(string_split(text, ' ')) AS term FROM seen) WHERE term <> '' GROUP BY row, term) JOIN seen USING (row) GROUP BY lang, term, source""")
        con.unregister("seen")
        yield from _batches(con, f"FROM own WHERE docs < {COMMON}")
        rows += _run(con, f"INSERT INTO part FROM own WHERE docs >= {COMMON}")
        _run(con, "DROP TABLE own")
        if rows > FULL and (rows := _shorten(con)) > FULL // 2:
            yield from _batches(con, "FROM part")
            rows = _run(con, "DELETE FROM part") * 0
        tidy()
    yield from _batches(con, _SUMMED)
    con.close()


def _keep(least: int):
    """Counts of a shard to one row for each kept term and source, and one for the whole language (whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        _run(con, f"CREATE TABLE part ({_COUNTS})")
        rows, limit = 0, FULL
        for batch in batches:
            con.register("more", pa.Table.from_batches([batch]))
            rows += _run(con, "INSERT INTO part FROM more")
            con.unregister("more")
            if rows > limit:
                rows = _shorten(con)
                limit = max(FULL, 2 * rows)
        _run(con, f"CREATE TABLE k AS SELECT lang, term, sum(n)::BIGINT AS n FROM part GROUP BY lang, term HAVING sum(docs) >= {least}")
        yield from _batches(con, """SELECT part.lang, part.term, false AS whole, part.source, sum(part.n)::BIGINT AS n FROM part JOIN k ON k.lang = part.lang AND k.term = part.term GROUP BY part.lang, part.term, part.source
            UNION ALL SELECT lang, term, true, '', n FROM k""")
        con.close()
        tidy()

    return run


def _sum_shard(best: int):
    """Rated rows of a shard (lang, term, whole, source, n, total, terms) to partial pair sums (a before b) and the shard's
    best terms of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        _run(con, "CREATE TABLE r (lang VARCHAR, term VARCHAR, whole BOOLEAN, source VARCHAR, n BIGINT, total BIGINT, terms BIGINT)")
        for batch in batches:
            con.register("more", pa.Table.from_batches([batch]))
            _run(con, "INSERT INTO r FROM more")
            con.unregister("more")
        _run(con, "CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
        _run(con, f"CREATE TABLE p AS SELECT lang, term, whole, source, (1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * terms))::BIGINT AS p, (1 + {2 * SCALE}::HUGEINT // (total + 2 * terms))::BIGINT AS p0 FROM r")
        yield from _batches(con, """SELECT 'pair' AS part, x.lang, x.source, y.source AS item, sum(f(x.p, y.p) - f(x.p, y.p0) - f(x.p0, y.p) + f(x.p0, y.p0))::BIGINT AS value
            FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND x.source < y.source WHERE NOT x.whole AND NOT y.whole GROUP BY ALL""")
        yield from _batches(con, f"""SELECT 'term' AS part, g.lang, g.source, g.term AS item, f(g.p, l.p) AS value FROM p g JOIN p l ON l.lang = g.lang AND l.term = g.term
            WHERE l.whole AND NOT g.whole AND g.p > l.p QUALIFY row_number() OVER (PARTITION BY g.lang, g.source ORDER BY value DESC, item) <= {best}""")
        con.close()

    return run


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), 0 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * terms)) + 1).otherwise(F.lit(0)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0)).cast("long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source of a language from its other sources, and the
    terms by which it stands out most from its language."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_count, "lang string, term string, source string, n long, docs long")
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = materialize(counts.repartition(shards, "lang", "term").mapInArrow(_keep(least_docs), "lang string, term string, whole boolean, source string, n long"), "kept")
    sums = kept.groupBy("lang", "whole", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    known = rows.select("lang", F.lit(False).alias("whole"), "source").distinct().unionByName(sums.where("whole").select("lang", "whole", "source"))
    terms = sums.where("whole").select("lang", F.col("held").alias("terms"))
    groups = known.join(sums, ["lang", "whole", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "held", "terms"])
    groups = materialize(groups, "groups")
    rated = kept.join(groups, ["lang", "whole", "source"]).select("lang", "term", "whole", "source", "n", "total", "terms")
    found = materialize(rated.repartition("lang", "term").mapInArrow(_sum_shard(best), "part string, lang string, source string, item string, value long"), "partial")

    # a share that a term has in one source against that of all terms which the other lacks, for each count
    lacking = _share(F.lit(0), F.col("total"), F.col("terms"))
    sources = groups.where("not whole").withColumn("p0", lacking)
    a, b = (sources.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "held", "p0")), "terms") for s in "ab")
    each = kept.where("not whole").groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(sources, ["lang", "source"])
    each = each.select("lang", F.col("source").alias("source_a"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "times")
    one = each.join(b, "lang").where("source_a <> source_b").groupBy("lang", F.least("source_a", "source_b").alias("source"), F.greatest("source_a", "source_b").alias("item"))
    one = one.agg(F.sum(F.col("times") * _gap(F.col("p"), F.col("p0_b"))).alias("value"))
    rest = a.join(b.drop("terms"), "lang").where("source_a < source_b")
    rest = rest.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), ((F.col("terms") - F.col("held_a") - F.col("held_b")) * _gap(F.col("p0_a"), F.col("p0_b"))).alias("value"))
    both = found.where("part = 'pair'").drop("part").unionByName(one).unionByName(rest).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = both.select("lang", turned.alias("t"), "value").select("lang", "t.source", F.lit("pair").alias("part"), "t.item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top.select("lang", "source", "part", "item", "value", "rank"))
