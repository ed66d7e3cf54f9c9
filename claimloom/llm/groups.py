"""Groups of rows in sorted partitions, without a call for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from claimloom.llm.textbuf import tidy


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches of a partition sorted by its first ``keys`` columns (longs or ints): tables of whole groups, and
    where the groups begin (and the total)."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        starts = _starts(rest, keys)
        if len(starts) > 2:
            cut = int(starts[-2])
            yield rest.slice(0, cut).combine_chunks(), starts[:-1]
            rest = rest.slice(cut)
            tidy()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _starts(rest, keys)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in range(keys):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)
