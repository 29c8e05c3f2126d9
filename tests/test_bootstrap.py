"""Array bootstrap, past quantiles, block products and ranges against plain Python."""

import bisect
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import blocks, scans, streams
from panelyard.operators import bootstrap as B
from panelyard.operators import features as X
from panelyard.operators import metrics as M


def precision(rows):
    """Average precision over distinct scores of (score, y, weight)."""
    total = sum(w * y for _, y, w in rows)
    tp = flagged = gain = 0
    for s in sorted({s for s, *_ in rows}, reverse=True):
        pos, n = sum(w * y for t, y, w in rows if t == s), sum(w for t, _, w in rows if t == s)
        tp, flagged = tp + pos, flagged + n
        gain += pos * tp / flagged if flagged else 0
    return gain / total if 0 < total < flagged else None


@pytest.mark.parametrize("block_bytes", [32 << 20, 70])
def test_precision_by_draw_equals_plain_python(spark, block_bytes):
    r = random.Random(2)
    rows = [(r.randint(1, 7), r.choice([None, *[k / 8 for k in range(9)]]), r.random(), r.choice([0, 0, 1, None])) for _ in range(400)]
    rows += [(9, 0.5, 0.1, 0)] * 30
    df = spark.createDataFrame(rows, "place long, a double, b double, y int").repartition(5)
    got = {(x.arm, x.draw): x.ap for x in B.average_precision_by_draw(df, "place", 12, {"a": "a", "b": "b"}, block_bytes=block_bytes).collect()}
    ids = sorted({x[0] for x in rows})
    for arm, k in (("a", 1), ("b", 2)):
        for draw in range(13):
            times = dict(zip(ids, B.times_drawn(draw, len(ids)), strict=True))
            want = precision([(x[k], x[3], int(times[x[0]])) for x in rows if x[k] is not None and x[3] is not None])
            assert got.get((arm, draw)) == (pytest.approx(want, abs=1e-12) if want is not None else None)


def test_bootstrap_finds_a_planted_gain(spark):
    """20 groups of 200 rows: the candidate ranks positives higher in every group."""
    r = random.Random(8)
    rows = []
    for g in range(20):
        for _ in range(200):
            y = int(r.random() < 0.2)
            rows.append((g, y, r.random() + 0.2 * y, r.random() + 0.6 * y, r.random()))
    df = spark.createDataFrame(rows, "g long, y int, base double, better double, noise double")
    assert B.cluster_bootstrap_compare(df, "g", 400, "base", "better").first()["verdict"] == "SHIP"
    assert B.cluster_bootstrap_compare(df, "g", 400, "better", "base").first()["verdict"] == "REGRESSION"
    same = B.cluster_bootstrap_compare(df, "g", 100, "base", "base").first()
    assert (same["delta"], same["ci_low"], same["ci_high"], same["verdict"]) == (0, 0, 0, "noise")
    one = B.cluster_bootstrap_ci(df, "g", 400, p="better").first()
    assert one["ci_low"] < one["ap"] < one["ci_high"] and one["n_draws"] == 400


def test_bootstrap_plan_has_no_rows_by_draws(spark):
    df = spark.createDataFrame([(g, g % 2, g / 7) for g in range(40)], "g long, y int, p double")
    plan = B.average_precision_by_draw(df, "g", 2000, {"own": "p"})._jdf.queryExecution().executedPlan().toString()
    # the one Generate deals rows to blocks of draws, here one
    assert "BroadcastHashJoin" not in plan and "Cartesian" not in plan and plan.count("Generate explode") <= 1
    assert B.cluster_weights(df, "g", 2000).agg(F.max("block")).first()[0] == 0


def test_folds_equal_plain_python(spark):
    deltas = [(1996, 0.1), (1997, -0.2), (1998, 0.4), (1999, 0.05)]
    df = spark.createDataFrame(deltas, "fold long, delta double")
    got = B.paired_fold_bootstrap(df, 300).first()
    means = [np.average([d for _, d in deltas], weights=B.times_drawn(k, 4)) for k in range(1, 301)]
    assert got["delta"] == pytest.approx(0.0875) and got["n_folds"] == 4
    assert (got["ci_low"], got["ci_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    small = B.paired_fold_bootstrap(df, 300, block_bytes=50).first()
    assert tuple(small) == pytest.approx(tuple(got))


# -- past quantiles -------------------------------------------------------------------------


def by_sorting(values, share):
    seen, out = [], []
    for x in values:
        place = share * (len(seen) - 1)
        low = int(place) if seen else 0
        out.append(None if not seen else seen[low] if low == place else (low + 1 - place) * seen[low] + (place - low) * seen[low + 1])
        if x is not None:
            bisect.insort(seen, x)
    return out


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_past_quantile_equals_sorting(spark, share):
    r = random.Random(int(share * 100))
    series = {e: [r.choice([None, r.random(), 0.5, -1.0]) for _ in range(r.randint(1, 300))] for e in (1, 2, 3, None)}
    rows = [(e, k, x, "kept") for e, s in series.items() for k, x in enumerate(s)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "entity long, week int, v double, other string").repartition(7)
    got = {}
    for x in streams.past_quantile(df, ["entity"], ["week"], "v", share, "q").collect():
        got.setdefault(x.entity, {})[x.week] = x.q
        assert x.other == "kept"
    for e, s in series.items():
        assert [got[e][k] for k in range(len(s))] == pytest.approx(by_sorting(s, share))


def test_past_quantile_grows_as_n_log_n():
    def took(n):
        r, q = random.Random(1), streams.PastQuantile(0.25)
        values = [r.random() for _ in range(n)]
        began = time.perf_counter()
        for v in values:
            q.value()
            q.add(v)
        return time.perf_counter() - began

    took(1000)
    assert min(took(100_000) for _ in range(2)) < 25 * max(min(took(10_000) for _ in range(3)), 1e-3)


# -- block products -------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "stretch"), [(256, 512), (3, 4)])
def test_block_product_equals_sums(spark, block, stretch):
    r = random.Random(block)
    pairs = [(a, b, r.random()) for a in range(11) for b in range(14) if a != b and r.random() < 0.8] + [(1, 2, 0.5)]
    weeks = [f"2001-{m:02d}-{d:02d}" for m in (1, 3, 7) for d in (1, 8, 15)] + ["1960-05-02"]
    values = [(o, w, r.choice([None, r.random()])) for o in range(13) for w in weeks if r.random() < 0.7] + [(2, weeks[0], 1.5)]
    want = {}
    for a, b, w in pairs:
        for o, at, v in values:
            if o == b and v is not None:
                want[a, at] = want.get((a, at), 0) + w * v
    got = blocks.weighted_sums(spark.createDataFrame(pairs, "row long, other long, weight double"), spark.createDataFrame(values, "other long, at string, value double").withColumn("at", F.col("at").cast("date")), block, stretch).collect()
    found = {(x.row, str(x["at"])): x.total for x in got}
    assert len(found) == len(got)
    assert {k: v for k, v in found.items() if v} == {k: pytest.approx(v) for k, v in want.items()}


def test_force_joins_no_rows_with_pairs(spark):
    panel = spark.createDataFrame([(e, f"2001-01-{d:02d}", 1.0 * e, 1) for e in range(4) for d in (1, 8)], "entity long, week_start string, inc double, hot int").withColumn("week_start", F.col("week_start").cast("date"))
    pairs = spark.createDataFrame([(a, b, 1e6) for a in range(4) for b in range(4) if a != b], "entity long, other long, weight double")
    pushed = X.force(panel, pairs, "f")
    assert "Join" not in pushed._jdf.queryExecution().executedPlan().toString()
    assert {(x.entity, x.f) for x in pushed.collect()} == {(0, 6.0), (1, 5.0), (2, 4.0), (3, 3.0)}
    rows = X.importation_force(panel.withColumn("hot", (F.col("entity") == 3).cast("int")), pairs).collect()
    assert {(x.entity, x.import_force) for x in rows} == {(0, 3.0), (1, 3.0), (2, 3.0), (3, 0.0)}


# -- ranges ---------------------------------------------------------------------------------


def test_equal_scores_are_split(spark):
    """90 % of rows have one score: no range above twice the median, and the rank form is exact."""
    r = random.Random(6)
    rows = [(k, 0.5 if r.random() < 0.9 else r.random(), int(r.random() < 0.3)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "k long, p double, y int").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = sorted(x["count"] for x in scans.in_ranges(df, F.desc("p"), "k").groupBy("_range").count().collect())
        got = M.rank_average_precision(df.withColumn("one", F.lit(1)), ["one"], [F.col("k")]).first()["ap_rank"]
        ranked = M.rank_average(df.withColumn("q", -F.col("p")), [], "p", "q").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    tp, total = 0, 0
    for n, (_, _, y) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        tp += y
        total += y * tp / n
    assert got == pytest.approx(total / tp)
    assert {x.rank_mean for x in ranked} == {(len(rows) + 1) / 2}


def test_rank_average_of_ties_and_nulls(spark):
    rows = [(1, 0.5, 3.0), (1, 0.5, None), (1, None, 1.0), (2, 7.0, 7.0), (None, 1.0, 1.0), (None, 1.0, 2.0)]
    got = M.rank_average(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], "a", "b").collect()
    want = {(1, 0.5, 3.0): 2.75, (1, 0.5, None): 1.75, (1, None, 1.0): 1.5, (2, 7.0, 7.0): 1.0, (None, 1.0, 1.0): 1.25, (None, 1.0, 2.0): 1.75}
    assert {(x.g, x.a, x.b): x.rank_mean for x in got} == want
