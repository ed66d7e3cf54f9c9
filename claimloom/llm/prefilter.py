"""A bitmap of fixed size that keeps rows which cannot match out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken, name = {c.lower() for c in df.columns}, f"__claimloom_{name}"
    while name in taken:
        name += "_"
    return name


def _marked(df: DataFrame, column: str, wanted: DataFrame, bits: int, how: str) -> tuple[DataFrame, str]:
    """The rows with three more columns of unused names, and the condition that a row's bit is set."""
    value, at, word, held = wanted.columns[0], free_name(df, "at"), free_name(df, "word"), free_name(df, "bits")
    place = "pmod(xxhash64(`{}`), %d)" % (1 << bits)
    words = (
        wanted.selectExpr(f"{place.format(value)} AS h").selectExpr(f"h div 64 AS {word}", "shiftleft(1L, cast(h % 64 AS int)) AS b")
        .groupBy(word).agg(F.bit_or("b").alias(held))
    )
    marked = df.withColumn(at, F.expr(place.format(column))).withColumn(word, F.expr(f"{at} div 64"))
    return marked.join(F.broadcast(words), word, how), f"({held} & shiftleft(1L, cast({at} % 64 AS int))) <> 0"


def may_match(df: DataFrame, column: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the values of ``wanted``'s only column; none that is gets lost.

    The values are hashed to a bitmap of 2**bits bits, broadcast as at most 2**(bits - 6) rows of two longs whatever the
    size of ``wanted``; with very many values it lets more rows through, which an exact join afterwards drops."""
    marked, hit = _marked(df, column, wanted, bits, "inner")
    return marked.where(hit).select(*[f"`{c}`" for c in df.columns])


def split_by_match(df: DataFrame, column: str, wanted: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` is surely not among ``wanted``'s values, and those where it may be."""
    marked, hit = _marked(df, column, wanted, bits, "left")
    rest = [f"`{c}`" for c in df.columns]
    return marked.where(f"not coalesce({hit}, false)").select(*rest), marked.where(hit).select(*rest)
