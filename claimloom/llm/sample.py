"""Bounded samples by thresholds on hashes: no ranks, no sorts, no task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = (1 << 63) - 1


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """For each group (with the number of its rows) the hash up to which about ``most`` of its rows lie; all if there are
    no more."""
    return {g: TOP if n <= most else TOP * most // n for g, n in counts.items()}


def drawn(*key: Column | str) -> Column:
    """A hash of a row's key between 0 and ``TOP``."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1)


def share_of(group: Column, share: dict[str, int]) -> Column:
    """The share of each row's group as a column; -1 for other groups."""
    out = F.lit(-1).cast("long")
    for g, s in sorted(share.items(), key=lambda x: str(x[0])):
        out = F.when(group == F.lit(g), F.lit(s)).otherwise(out)
    return out
