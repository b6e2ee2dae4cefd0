"""Groups of a sorted partition, read in runs of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 50_000


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of at least ``rows`` rows, and the number of the group of each row.

    The partition must be sorted by the key, whose values aren't null.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            last = {c: held[-1].column(c)[held[-1].num_rows - 1] for c in key}
            same = np.ones(batch.num_rows, bool)
            for c in key:
                same &= pc.equal(batch.column(c), last[c]).to_numpy(zero_copy_only=False)
            cut = int(np.argmin(same)) if not same.all() else batch.num_rows
            if cut < batch.num_rows:
                held.append(batch.slice(0, cut))
                yield _numbered(held, key)
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield _numbered(held, key)


def _numbered(held: list[pa.RecordBatch], key: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(t.num_rows, bool)
    for c in key:
        v = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    return t, np.cumsum(new)


def bounds(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each group in rows that are sorted by it."""
    cuts = np.nonzero(np.diff(group))[0] + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)])
