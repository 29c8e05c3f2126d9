"""Many logistic fits side by side from one staged table: refits on permuted labels, and random search in nested folds.

A row carries its labels and its folds as short arrays, one element for each permutation
or repeat, so the features are stored once however many fits there are. One Newton step of
all fits is one Spark job: tasks add up gradients and curvatures of all fits over their
rows, groups of tasks are summed, and what reaches the driver is at most ``SLOTS`` rows of
fits x features^2 numbers. A few steps do, so hundreds of fits read the table some ten times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scans import running, written
from panelyard.functions.streams import Batches
from panelyard.operators.metrics import quantile_row, roc_auc
from panelyard.operators.splits import hash_number

#: Partial sums are gathered in so many groups before the driver adds them.
SLOTS = 64
#: Rows looked at together.
ROWS = 4096
STEPS, CLOSE = 15, 1e-9
BINS = 512


@dataclass(frozen=True)
class Fit:
    """One fit: the place of its label, what it leaves out as (place of a fold, value), and the weight of the squared coefficients."""

    label: int = 0
    without: tuple[tuple[int, int], ...] = ()
    ridge: float = 1.0


@dataclass
class Design:
    """Feature columns as tasks use them: nulls at the median, then centred and scaled, and a constant."""

    columns: tuple[str, ...]
    fill: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def matrix(self, rows: pa.RecordBatch) -> np.ndarray:
        x = np.stack([rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.columns], axis=1)
        x = (np.where(np.isnan(x), self.fill, x) - self.center) / self.scale
        return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def design(rows: DataFrame, columns: Sequence[str]) -> Design:
    """Medians, means and deviations of the columns: one row of numbers."""
    medians = quantile_row(rows, columns, [0.5]).first()
    fill = np.array([medians[c][0] if medians[c] else 0.0 for c in columns])
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(v))) for c, v in zip(columns, fill, strict=True)]
    facts = rows.agg(*(F.avg(c) for c in filled), *(F.stddev_pop(c) for c in filled)).first()
    n = len(columns)
    center, scale = (np.array([v or 0.0 for v in facts[k : k + n]]) for k in (0, n))
    return Design(tuple(columns), fill, center, np.where(scale > 0, scale, 1.0))


def _lists(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """Arrays of one length as a matrix; a null is -1."""
    return rows.column(name).flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.int64)


def _added(like: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``work`` says of some of them: by task, by group of tasks, then here."""
    def part(batches: Batches) -> Batches:
        total = np.zeros(size)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                total += work(batch.slice(k, ROWS))
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "total"])

    def gather(group: pa.Table) -> pa.Table:
        lists = group.column("total").combine_chunks()
        total = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).sum(axis=0)
        return pa.table({"total": pa.array([total], pa.list_(pa.float64()))})

    sums = like.mapInArrow(part, "slot int, total array<double>").groupBy("slot").applyInArrow(gather, "total array<double>").collect()
    return np.sum([np.array(r["total"]) for r in sums], axis=0) if sums else np.zeros(size)


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))


def fit_many(rows: DataFrame, shape: Design, fits: Sequence[Fit]) -> np.ndarray:
    """Coefficients (features and a constant, by fit) of ridge logistic fits; rows: the features, ``ys`` and ``folds``, a written table."""
    d, m = len(shape.columns) + 1, len(fits)
    label = np.array([f.label for f in fits])
    ridge = np.array([f.ridge for f in fits]) * np.append(np.ones(d - 1), 0.0)[:, None]
    w = np.zeros((d, m))

    def work(at: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def sums(part: pa.RecordBatch) -> np.ndarray:
            x, y, folds = shape.matrix(part), _lists(part, "ys")[:, label], _lists(part, "folds")
            use = y >= 0
            for k, f in enumerate(fits):
                for place, value in f.without:
                    use[:, k] &= folds[:, place] != value
            p = chance(x, at)
            gradient = x.T @ np.where(use, y - p, 0.0)
            curve = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d).T @ np.where(use, p * (1 - p), 0.0)
            return np.concatenate((gradient.ravel(), curve.ravel()))

        return sums

    for _ in range(STEPS):
        total = _added(rows, work(w), d * m + d * d * m)
        gradient = total[: d * m].reshape(d, m) - ridge * w
        curve = total[d * m :].reshape(d, d, m).transpose(2, 0, 1) + 1e-9 * np.eye(d)
        curve[:, np.arange(d), np.arange(d)] += ridge.T
        move = np.linalg.solve(curve, gradient.T[:, :, None])[:, :, 0].T
        # a step of a nearly separable fit may overshoot
        move *= np.minimum(1.0, 5.0 / np.maximum(np.abs(move).max(axis=0), 1e-12))
        w = w + move
        if np.abs(move).max() < CLOSE:
            break
    return w


def out_of_fold(rows: DataFrame, shape: Design, w: np.ndarray, table: np.ndarray) -> DataFrame:
    """``ps``: for each place s of the folds the probability of fit ``table[s, fold]``."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x, folds = shape.matrix(batch), _lists(batch, "folds")
            p = np.stack([(x * w[:, table[s, folds[:, s]]].T).sum(axis=1) for s in range(len(table))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(p, -35, 35)))
            ends = pa.array(np.arange(len(p) + 1) * len(table), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], [*batch.schema.names, "ps"])

    return rows.mapInArrow(run, rows.withColumn("ps", F.lit(None).cast("array<double>")).schema)


# -- refits on permuted labels --------------------------------------------------------------


def permuted(df: DataFrame, seeds: int, keys: Sequence[str], y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(rows with their number ``_n``, (seed, _n, y)): labels permuted by pairing the order of a hash with the order of the keys."""
    numbered = running(df, [], keys[0], {"_n": F.lit(1)}, order=[F.col(k) for k in keys[1:]])
    seed = F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed")
    hashed = df.select(*keys, y, seed).withColumn("_h", hash_number(F.col("seed"), *(F.col(k) for k in keys)))
    right = running(hashed, ["seed"], "_h", {"_n": F.lit(1)}, order=[F.col(k) for k in keys])
    return numbered, right.select("seed", "_n", F.col(y).alias("y"))


def refit_null(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seeds: int = 10, folds: int = 5, y: str = "y", ridge: float = 1.0) -> DataFrame:
    """AUC of out-of-fold scores of refitted models: the true labels against permuted ones, mean, deviation and z.

    Seed 0 has the true labels. Every seed has its own folds, dealt evenly within the
    classes of its own labels. One row: true_auc, null_mean, null_sd, z, n_refits. ``keys`` tell rows apart.
    """
    numbered, shuffled = permuted(df.where(F.col(y).isNotNull()), seeds, keys, y)
    numbered = written(numbered.select("_n", F.col(y).cast("int").alias("_y"), *columns))
    labels = numbered.select(F.lit(0).alias("seed"), "_n", F.col("_y").alias("y")).unionByName(shuffled.select("seed", "_n", F.col("y").cast("int").alias("y")))
    dealt = running(labels.withColumn("_h", hash_number(F.lit("fold"), F.col("seed"), F.col("_n"))), ["seed", "y"], "_h", {"_k": F.lit(1)}, order=[F.col("_n")])
    # as many elements as there are seeds
    by = dealt.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("seed", "y", ((F.col("_k") - 1) % folds).cast("int").alias("fold")))).alias("s"))
    arrays = by.select("_n", F.transform("s", lambda s: s["y"]).alias("ys"), F.transform("s", lambda s: s["fold"]).alias("folds"))
    rows = written(numbered.drop("_y").join(arrays.hint("merge"), "_n"))
    shape = design(rows, columns)
    fits = [Fit(s, ((s, k),), ridge) for s in range(seeds + 1) for k in range(folds)]
    w = fit_many(rows, shape, fits)
    scored = out_of_fold(rows, shape, w, np.arange(len(fits)).reshape(seeds + 1, folds))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(seeds)), lambda s: F.struct(s.alias("seed"), F.get("ys", s).alias("y"), F.get("ps", s).alias("p")))).alias("e")
    auc = written(roc_auc(scored.select(each).select("e.*"), ["seed"]))
    null = auc.where("seed > 0").agg(F.avg("roc_auc").alias("null_mean"), F.stddev_pop("roc_auc").alias("null_sd"), F.count("roc_auc").alias("n_refits"))
    own = auc.where("seed = 0").agg(F.max("roc_auc").alias("true_auc"))
    z = (F.col("true_auc") - F.col("null_mean")) / F.greatest("null_sd", F.lit(1e-9))
    return own.crossJoin(F.broadcast(null)).select("true_auc", "null_mean", "null_sd", z.alias("z"), "n_refits")


# -- random search in nested folds ----------------------------------------------------------


@dataclass(frozen=True)
class Search:
    """How parameters are drawn: ``ridge`` log-uniform between two bounds, ``draws`` times for each outer fold of each repeat."""

    draws: int = 25
    ridge: tuple[float, float] = (1e-3, 1e3)
    inner: int = 4
    seed: int = 7
    chosen: dict = field(default_factory=dict, compare=False)

    def sample(self, repeat: int, fold: int) -> np.ndarray:
        low, high = np.log(self.ridge)
        return np.exp(np.random.default_rng([self.seed, repeat, fold]).uniform(low, high, self.draws))


def _auc(counts: np.ndarray) -> np.ndarray:
    """AUC from counts (.., class, bin) with ties of a bin at half; 0.5 if a class is absent."""
    no, yes = counts[..., 0, :], counts[..., 1, :]
    below = np.cumsum(no, axis=-1) - no
    wins, pairs = (yes * (below + no / 2)).sum(axis=-1), yes.sum(axis=-1) * no.sum(axis=-1)
    return np.where(pairs > 0, wins / np.maximum(pairs, 1), 0.5)


def nested_search(df: DataFrame, columns: Sequence[str], key: str, outer: int, repeats: int, search: Search | None = None, y: str = "y") -> DataFrame:
    """(key, y, fold, p): out-of-fold probabilities averaged over repeats; ``fold`` is that of the first repeat.

    Every outer fold draws its own parameters, tries each on inner folds of its own
    training rows, keeps the one with the best AUC (counted in ``BINS`` bins of the
    probability) and is refitted with it. Draws depend on the seed, repeat and fold alone,
    so a rerun gives the same rows; what was chosen is in ``search.chosen``.
    """
    search = search or Search()
    base = written(df.where(F.col(y).isNotNull()).select(key, F.col(y).cast("int").alias("_y"), *columns))

    def deal(name: str, parts: int) -> DataFrame:
        rows = base.select(key, "_y", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
        ran = running(rows.withColumn("_h", hash_number(F.lit(name), F.col(key), F.col("repeat"))), ["repeat", "_y"], "_h", {"_k": F.lit(1)}, order=[F.col(key)])
        by = ran.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("repeat", ((F.col("_k") - 1) % parts).cast("int").alias("f")))).alias("s"))
        return by.select(key, F.transform("s", lambda s: s["f"]).alias(name))

    outer_, inner_ = deal("outer", outer), deal("inner", search.inner)
    joined = base.join(outer_.hint("merge"), key).join(inner_.hint("merge"), key)
    rows = written(joined.select(key, *columns, F.array("_y").alias("ys"), F.concat("outer", "inner").alias("folds")))
    shape = design(rows, columns)
    places = [(r, k) for r in range(repeats) for k in range(outer)]
    drawn = {at: search.sample(*at) for at in places}
    fits = [Fit(0, ((r, k), (repeats + r, j)), float(x)) for r, k in places for x in drawn[r, k] for j in range(search.inner)]
    w = fit_many(rows, shape, fits)
    index = np.arange(len(fits)).reshape(len(places), search.draws, search.inner)
    size = (len(places), search.draws, 2, BINS)

    def count(part: pa.RecordBatch) -> np.ndarray:
        x, label, folds = shape.matrix(part), _lists(part, "ys")[:, 0], _lists(part, "folds")
        out = np.zeros(size)
        for n, (r, k) in enumerate(places):
            for j in range(search.inner):
                use = (folds[:, r] != k) & (folds[:, repeats + r] == j)
                place = np.minimum((chance(x[use], w[:, index[n, :, j]]) * BINS).astype(np.int64), BINS - 1)
                flat = (np.arange(search.draws) * 2 + label[use, None]) * BINS + place
                out[n] += np.bincount(flat.ravel(), minlength=search.draws * 2 * BINS).reshape(size[1:])
        return out.ravel()

    auc = _auc(_added(rows, count, int(np.prod(size))).reshape(size))
    best = {at: float(drawn[at][int(np.argmax(auc[n]))]) for n, at in enumerate(places)}
    search.chosen.update(best)
    last = fit_many(rows, shape, [Fit(0, ((r, k),), best[r, k]) for r, k in places])
    scored = out_of_fold(rows, shape, last, np.arange(len(places)).reshape(repeats, outer))
    mean = F.aggregate("ps", F.lit(0.0), lambda t, p: t + p) / repeats
    return scored.select(key, F.get("ys", F.lit(0)).alias(y), F.get("folds", F.lit(0)).alias("fold"), mean.alias("p"))

