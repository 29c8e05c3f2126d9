"""Sorted groups as streams: what needs the rows of a group in order, without holding the group.

Rows are dealt out by the keys of their groups and sorted; a function then sees them
batch by batch and keeps what it must. Unlike a grouped Arrow function nothing of the
size of a group is ever in memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def starts(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    """The places where a row's keys differ from those of the row before; 0 is one. Nulls are equal to nulls."""
    n = batch.num_rows
    if not n:
        return []
    out = None
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out = new if out is None else pc.or_(out, new)
    return [0, *(i + 1 for i in pc.indices_nonzero(out).to_pylist())] if out is not None else [0]


def pieces(batches: Batches, keys: Sequence[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(keys, whether a group begins, rows of one group): groups go on from batch to batch."""
    last = None
    for batch in batches:
        cuts = starts(batch, keys)
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            yield key, key != last, batch.slice(start, stop - start)
            last = key


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], run: Callable[[Batches], Batches], schema: str | object) -> DataFrame:
    """``run`` over the rows of each partition, groups of ``keys`` whole and one after the other, each in ``order``."""
    dealt = df.repartition(*map(F.col, keys)) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*map(F.col, keys), *order).mapInArrow(run, schema)


class PastQuantile:
    """The quantile of what was added so far, by linear interpolation: two heaps that meet at its place.

    The lower one holds the values up to the place below the quantile; that place never
    falls and rises by one at most, so an addition costs the logarithm of their number.
    """

    def __init__(self, share: float) -> None:
        self.share, self.below, self.above = share, [], []

    def value(self) -> float | None:
        n = len(self.below) + len(self.above)
        if not n:
            return None
        place = self.share * (n - 1)
        low, a = len(self.below) - 1, -self.below[0]
        if place <= low or not self.above or self.above[0] == a:
            return a
        return (low + 1 - place) * a + (place - low) * self.above[0]

    def add(self, x: float) -> None:
        n = len(self.below) + len(self.above) + 1
        if self.below and x < -self.below[0]:
            heapq.heappush(self.below, -x)
        else:
            heapq.heappush(self.above, x)
        wanted = int(self.share * (n - 1)) + 1
        while len(self.below) < wanted:
            heapq.heappush(self.below, -heapq.heappop(self.above))
        while len(self.below) > wanted:
            heapq.heappush(self.above, -heapq.heappop(self.below))


def past_quantile(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, share: float, name: str) -> DataFrame:
    """``name``: the exact quantile of all earlier values of the group, by linear interpolation; nulls are passed over.

    n log n for a group of n rows. A group is one series and runs in one task; of it, its
    values alone are held.
    """
    schema = df.withColumn(name, F.lit(None).cast("double")).schema

    def run(batches: Batches) -> Batches:
        state = PastQuantile(share)
        for _, fresh, rows in pieces(batches, keys):
            if fresh:
                state = PastQuantile(share)
            out = []
            for x in pc.cast(rows.column(column), pa.float64()).to_pylist():
                out.append(state.value())
                if x is not None:
                    state.add(x)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.float64())], [*rows.schema.names, name])

    return in_order(df, keys, order, run, schema)
