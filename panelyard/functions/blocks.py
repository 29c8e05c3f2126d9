"""Sums of one table's values under the weights of pairs, as a product of blocks.

Where pairs are the square of the keys, joining rows with pairs makes rows x keys. Here
keys are dealt into blocks and times into stretches; a block of results goes through the
blocks of the other side one after the other, one tile of weights and one of values at a
time, and multiplies them as matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.streams import Batches, in_order, pieces

#: Keys of a block, and weeks of a stretch.
BLOCK, STRETCH = 256, 512


class _Tile:
    """The results of one block and stretch so far, and the weights of the block's tile at hand."""

    def __init__(self) -> None:
        self.rows: dict = {}
        self.times: dict = {}
        self.total = np.zeros((0, 0))
        self.next_tile()

    def next_tile(self) -> None:
        self.columns: dict = {}
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.weights = None

    @staticmethod
    def places(values: list, known: dict) -> np.ndarray:
        return np.array([known.setdefault(v, len(known)) for v in values], np.int64)

    def weigh(self, part: pa.RecordBatch) -> None:
        self.cells.append((self.places(part.column("row").to_pylist(), self.rows), self.places(part.column("other").to_pylist(), self.columns), part.column("value").to_numpy(zero_copy_only=False)))

    def add(self, part: pa.RecordBatch) -> None:
        if not self.cells:
            return
        if self.weights is None:
            self.weights = np.zeros((len(self.rows), len(self.columns)))
            for r, c, w in self.cells:
                np.add.at(self.weights, (r, c), w)
        own = [(self.columns[o], t, v) for o, t, v in zip(part.column("other").to_pylist(), part.column("at").to_pylist(), part.column("value").to_pylist(), strict=True) if o in self.columns]
        if not own:
            return
        column, at, value = zip(*own, strict=True)
        place = self.places(at, self.times)
        seen, local = np.unique(place, return_inverse=True)
        values = np.zeros((len(self.columns), len(seen)))
        np.add.at(values, (np.array(column), local), np.array(value))
        grown = np.zeros((len(self.rows), len(self.times)))
        grown[: self.total.shape[0], : self.total.shape[1]] = self.total
        grown[:, seen] += self.weights @ values
        self.total = grown

    def told(self, types: list[pa.DataType]) -> Batches:
        rows, times = list(self.rows), list(self.times)
        for k in range(self.total.shape[0]):
            n = self.total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([rows[k]] * n, types[0]), pa.array(times[:n], types[1]), pa.array(self.total[k])], ["row", "at", "total"])


def _multiply(batches: Batches) -> Batches:
    state, types = None, []
    for (_, _, _), fresh, part in pieces(batches, ["_i", "_t", "_j"]):
        key = (part.column("_i")[0].as_py(), part.column("_t")[0].as_py())
        if state is None or key != state[0]:
            if state is not None:
                yield from state[1].told(types)
            state = (key, _Tile())
        elif fresh:
            state[1].next_tile()
        types = [part.column(c).type for c in ("row", "at")]
        for (kind,), _, rows in pieces(iter([part]), ["kind"]):
            (state[1].weigh if kind == 0 else state[1].add)(rows)
    if state is not None:
        yield from state[1].told(types)


def weighted_sums(pairs: DataFrame, values: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """(row, at, total): for each row and date ``at`` the sum of weight x value over pairs (row, other, weight) and values (other, at, value).

    Dates of a row's stretch at which no other has a value are left out, or 0; null values
    count nothing. Weights of a pair that occurs twice are added, and so are values.
    """
    values = values.where("value is not null and other is not null and at is not null")
    week = F.floor(F.datediff("at", F.lit("1970-01-05").cast("date")) / (7 * stretch)).cast("long")
    n, low, high = values.agg(F.countDistinct("other"), F.min(week), F.max(week)).first()
    blocks = max(1, -(-n // block))
    of = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")
    nothing = F.lit(None)
    stretches = F.sequence(F.lit(low or 0).cast("long"), F.lit(high or 0).cast("long"))
    tiles = pairs.select(of("row").alias("_i"), F.explode(stretches).alias("_t"), of("other").alias("_j"), F.lit(0).alias("kind"), "row", "other", nothing.cast("date").alias("at"), F.col("weight").cast("double").alias("value"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    row_type = pairs.schema["row"].dataType
    vectors = values.select(F.explode(every).alias("_i"), week.alias("_t"), of("other").alias("_j"), F.lit(1).alias("kind"), nothing.cast(row_type).alias("row"), "other", F.col("at").cast("date").alias("at"), F.col("value").cast("double").alias("value"))
    return in_order(tiles.unionByName(vectors), ["_i", "_t"], ["_j", "kind"], _multiply, f"row {row_type.simpleString()}, at date, total double")
