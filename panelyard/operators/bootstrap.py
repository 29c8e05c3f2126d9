"""Bootstrap over clusters at any number of draws, from one sorted curve.

The times that a cluster is drawn, over all draws, are one array at that cluster. Rows are
added up by score and cluster, dealt into ranges of the score, and read once in falling
order; what runs along is one array of sums for each class, an element for each draw. So
rows are never multiplied by draws, and no table of draws by clusters is sent to every
task: a range gets the arrays of the clusters with its rows.

Draws go in blocks of as many as keep the arrays of all clusters below ``BLOCK_BYTES``;
with few clusters that is one block. Draw 0 takes every cluster once: the sample itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scans import in_ranges, running, written
from panelyard.functions.streams import Batches, in_order, pieces

#: The arrays of one block of draws, two bytes a draw and cluster, stay below this.
BLOCK_BYTES = 32 << 20
#: So many sums are worked on at a time.
CELLS = 1 << 20


def times_drawn(draw: int, clusters: int) -> np.ndarray:
    """How often each of so many clusters is drawn, with replacement, by the md5 of draw and place; draw 0 takes each once."""
    if not draw:
        return np.ones(clusters, np.int64)
    picks = [int(hashlib.md5(f"{draw}-{k}".encode()).hexdigest()[:8], 16) % clusters for k in range(clusters)]
    return np.bincount(picks, minlength=clusters)


def cluster_weights(df: DataFrame, cluster: str, draws: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(cluster, block, first, times): how often each cluster is drawn, an array for each block of draws from ``first`` on. Clusters count in their order."""
    numbered = written(running(df.select(cluster).distinct(), [], cluster, {"_place": F.lit(1)}).withColumn("_place", F.col("_place") - 1))
    n = numbered.count()
    size = max(1, min(draws + 1, block_bytes // (2 * max(n, 1))))
    blocks = -(-(draws + 1) // size)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if not n:
                    continue
                first = b * size
                times = np.stack([times_drawn(d, n) for d in range(first, min(first + size, draws + 1))], axis=1).astype(np.int32)
                step = max(1, CELLS // times.shape[1])
                for k in range(0, n, step):
                    part = times[k : k + step]
                    ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                    columns = [pa.array(np.arange(k, k + len(part)), pa.int64()), pa.array(np.full(len(part), b), pa.int64()), pa.array(np.full(len(part), first), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))]
                    yield pa.RecordBatch.from_arrays(columns, ["_place", "block", "first", "times"])

    spread = df.sparkSession.range(blocks, numPartitions=blocks)
    made = spread.mapInArrow(run, "_place long, block long, first long, times array<int>")
    return written(numbered.join(made.hint("merge"), "_place").drop("_place"))


def _matrix(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int32)


class _Range:
    """Sums along one range of one curve, an element for each draw of one block."""

    def __init__(self) -> None:
        self.times: list[np.ndarray] = []
        self.place: dict = {}
        self.before: list[np.ndarray] = []
        self.open: tuple[np.ndarray, ...] | None = None
        self.ready = False

    def weigh(self, rows: pa.RecordBatch) -> None:
        for c in rows.column("cluster").to_pylist():
            self.place[c] = len(self.place)
        self.times.append(_matrix(rows.column("times")))
        self.before.append(np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "all")]))

    def begin(self) -> None:
        self.w = np.concatenate(self.times).astype(np.float64)
        self.tp, self.flagged = np.concatenate(self.before, axis=1).astype(np.float64) @ self.w
        self.gain, self.pos, self.all = (np.zeros(self.w.shape[1]) for _ in range(3))
        self.ready = True

    def go_on(self, rows: pa.RecordBatch) -> None:
        if not self.ready:
            self.begin()
        at = np.array([self.place[c] for c in rows.column("cluster").to_pylist()])
        found = (rows.column("score").to_numpy(zero_copy_only=False), at, *(rows.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "all")))
        if self.open is not None:
            found = tuple(map(np.concatenate, zip(self.open, found, strict=True)))
        score = found[0]
        # the rows of the last score may go on
        cut = int(np.flatnonzero(score != score[-1])[-1]) + 1 if (score != score[-1]).any() else 0
        self.open = tuple(x[cut:] for x in found)
        self.add(*(x[:cut] for x in found))

    def add(self, score: np.ndarray, at: np.ndarray, pos: np.ndarray, all_: np.ndarray) -> None:
        step = max(1, CELLS // self.w.shape[1])
        bounds = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1]))) if len(score) else np.zeros(0, int)
        ends = np.append(bounds[1:], len(score))
        k = 0
        while k < len(bounds):
            last = max(k, int(np.searchsorted(ends, bounds[k] + step, side="right")) - 1)
            rows = slice(bounds[k], ends[last])
            w = self.w[at[rows]]
            p, n = (np.add.reduceat(x[rows, None] * w, bounds[k : last + 1] - bounds[k], axis=0) for x in (pos, all_))
            tp, flagged = self.tp + np.cumsum(p, axis=0), self.flagged + np.cumsum(n, axis=0)
            self.gain += (p * tp / np.maximum(flagged, 1)).sum(axis=0)
            self.pos += p.sum(axis=0)
            self.all += n.sum(axis=0)
            self.tp, self.flagged = tp[-1], flagged[-1]
            k = last + 1

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.ready:
            return None
        self.add(*self.open)
        return self.gain, self.pos, self.all


def _along(batches: Batches) -> Batches:
    """(arm, block, first, gain, pos, all) of each range from its clusters' arrays and then its rows."""
    names = ["arm", "block", "first", "gain", "pos", "all"]

    def told(key: tuple, first: int, state: _Range | None) -> Batches:
        sums = state.end() if state else None
        if sums is not None:
            lists = [pa.array([x], pa.list_(pa.float64())) for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[2]], pa.int64()), pa.array([first], pa.int64()), *lists], names)

    state, last, first = None, None, 0
    for key, fresh, rows in pieces(batches, ["arm", "_range", "block"]):
        if fresh:
            yield from told(last, first, state)
            state, last = _Range(), key
        for (kind,), _, part in pieces(iter([rows]), ["kind"]):
            if kind == 0:
                first = part.column("first")[0].as_py()
                state.weigh(part)
            else:
                state.go_on(part)
    yield from told(last, first, state)


def _per_draw(group: pa.Table) -> pa.Table:
    """(arm, draw, ap) of one arm and block: sums over its ranges; draws with one class are left out."""
    gain, pos, all_ = (_matrix(group.column(c).combine_chunks()).sum(axis=0) for c in ("gain", "pos", "all"))
    both = (pos > 0) & (pos < all_)
    draw = group.column("first")[0].as_py() + np.flatnonzero(both)
    return pa.table({"arm": pa.array([group.column("arm")[0].as_py()] * len(draw), pa.string()), "draw": pa.array(draw, pa.int64()), "ap": gain[both] / pos[both]})


def average_precision_by_draw(df: DataFrame, cluster: str, draws: int, scores: dict[str, str], y: str = "y", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(arm, draw, ap) for each score column (arm: its name) and draw; draw 0 is the sample itself. Rows without score or label are left out."""
    weights = cluster_weights(df, cluster, draws, block_bytes)
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(c).cast("double").alias("score")) for a, c in scores.items()))).alias("a")
    # rows of one cluster and all scores are added up before the arms multiply them
    added = df.where(F.col(y).isNotNull()).groupBy(F.col(cluster).alias("cluster"), *dict.fromkeys(scores.values())).agg(F.sum(y).cast("double").alias("pos"), F.count("*").cast("double").alias("all"))
    by = added.select("cluster", "pos", "all", arms).select("a.arm", "a.score", "cluster", "pos", "all").where("score is not null").groupBy("arm", "score", "cluster").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    dealt = in_ranges(by, "arm", F.desc("score"))
    # what each cluster has in the ranges before: every range of an arm for every cluster of it
    ranges = dealt.select("arm", "_range").distinct()
    met = dealt.groupBy("arm", "cluster").agg(F.lit(1).alias("_one")).join(ranges.hint("merge"), "arm").drop("_one")
    per = dealt.groupBy("arm", "_range", "cluster").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    earlier = Window.partitionBy("arm", "cluster").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = met.join(per.hint("merge"), ["arm", "_range", "cluster"], "left").select("arm", "_range", "cluster", *(F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("pos", "all")))
    nothing = F.lit(None)
    first = sums.join(weights.withColumnRenamed(cluster, "cluster").hint("merge"), "cluster").select("arm", "_range", "block", F.lit(0).alias("kind"), nothing.cast("double").alias("score"), "cluster", "pos", "all", "first", "times")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_blocks(weights)).cast("long"))).alias("block")
    then = dealt.select("arm", "_range", blocks, F.lit(1).alias("kind"), "score", "cluster", "pos", "all", nothing.cast("long").alias("first"), nothing.cast("array<int>").alias("times"))
    both = first.unionByName(then)
    along = in_order(both, ["arm", "_range", "block"], ["kind", F.desc("score"), "cluster"], _along, "arm string, block long, first long, gain array<double>, pos array<double>, all array<double>")
    return along.groupBy("arm", "block").applyInArrow(_per_draw, "arm string, draw long, ap double")


def _blocks(weights: DataFrame) -> int:
    return weights.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]


def interval(column: str) -> list:
    return [F.percentile(column, F.lit(share)).alias(name) for share, name in ((0.025, "ci_low"), (0.975, "ci_high"))]


def cluster_bootstrap_ci(df: DataFrame, cluster: str, draws: int, y: str = "y", p: str = "p") -> DataFrame:
    """Average precision with its interval over resampled clusters; draws with one class are left out."""
    ap = written(average_precision_by_draw(df, cluster, draws, {"own": p}, y))
    drawn = ap.where("draw > 0").agg(*interval("ap"), F.count("*").alias("n_draws"))
    # a sample of one class has 0, as average_precision says
    return ap.where("draw = 0").agg(F.coalesce(F.max("ap"), F.lit(0.0)).alias("ap")).crossJoin(drawn)


def _means(block: pa.Table) -> pa.Table:
    times = _matrix(block.column("times").combine_chunks()).astype(np.float64)
    delta = block.column("delta").to_numpy()
    draw = block.column("first")[0].as_py() + np.arange(times.shape[1])
    return pa.table({"draw": pa.array(draw, pa.int64()), "m": (delta @ times) / times.sum(axis=0)})


def paired_fold_bootstrap(deltas: DataFrame, draws: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mean of per-fold deltas with the 2.5 and 97.5 percentiles over resampled folds: (fold, delta)."""
    deltas = written(deltas.select("fold", F.col("delta").cast("double").alias("delta")))
    # a block holds so many draws that its arrays over all folds are bounded
    weighed = cluster_weights(deltas, "fold", draws, block_bytes).join(deltas.hint("merge"), "fold")
    ci = weighed.groupBy("block").applyInArrow(_means, "draw long, m double").where("draw > 0").agg(*interval("m"))
    return deltas.agg(F.avg("delta").alias("delta"), F.count("*").alias("n_folds")).crossJoin(ci)


def verdict(low, high):
    return F.when(low > 0, "SHIP").when(high < 0, "REGRESSION").otherwise("noise")


def cluster_bootstrap_compare(df: DataFrame, cluster: str, draws: int, base: str, candidate: str, y: str = "y") -> DataFrame:
    """Difference in average precision of two scores with its interval over clusters, and the verdict."""
    ap = average_precision_by_draw(df, cluster, draws, {"base": base, "cand": candidate}, y)
    gap = F.max(F.when(F.col("arm") == "cand", F.col("ap"))) - F.max(F.when(F.col("arm") == "base", F.col("ap")))
    # the last digits depend on where ranges are cut; equal scores shall differ by 0
    by = written(ap.groupBy("draw").agg(F.round(gap, 12).alias("d")))
    ci = by.where("draw > 0").agg(*interval("d"))
    own = by.where("draw = 0").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("delta"))
    n = df.agg(F.countDistinct(cluster).alias("n_folds"))
    return own.crossJoin(ci).crossJoin(n).withColumns({"unit": F.lit("districts"), "verdict": verdict(F.col("ci_low"), F.col("ci_high"))})


def ship_rule(by_fold: DataFrame, by_cluster: DataFrame) -> DataFrame:
    """Ship only if both intervals lie above 0."""
    a = by_fold.select(F.col("delta").alias("fold_delta"), F.col("ci_low").alias("fold_low"), F.col("ci_high").alias("fold_high"))
    b = by_cluster.select(F.col("delta").alias("cluster_delta"), F.col("ci_low").alias("cluster_low"), F.col("ci_high").alias("cluster_high"))
    helps = lambda k: F.col(f"{k}_low") > 0
    sure = lambda k: (F.col(f"{k}_low") > 0) | (F.col(f"{k}_high") < 0)
    return a.crossJoin(b).withColumns({"fold_significant": sure("fold"), "cluster_significant": sure("cluster"), "ship": helps("fold") & helps("cluster")})


#: Draws of the fold bootstrap and of the cluster bootstrap.
FOLD_DRAWS, CLUSTER_DRAWS = 10_000, 2_000
__all__: Sequence[str] = ("average_precision_by_draw", "cluster_bootstrap_ci", "cluster_bootstrap_compare", "cluster_weights", "paired_fold_bootstrap", "ship_rule", "times_drawn", "verdict")
