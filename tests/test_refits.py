"""Side-by-side fits, permuted refits, random search and parameter arms."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelyard.functions.scans import written
from panelyard.operators import models as G
from panelyard.operators import refits as R


def planted(n, seed, strength):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, z = r.gauss(0, 1), r.gauss(5, 3)
        p = 1 / (1 + math.exp(-(strength * x - 1)))
        rows.append((k, x if r.random() > 0.05 else None, z, 2.0, int(r.random() < p)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, x double, z double, same double, y int")


def test_many_fits_equal_single_fits(spark):
    df = frame(spark, planted(600, 1, 1.5)).fillna(0.0)
    rows = written(df.select("k", "x", "z", "y", F.array("y").alias("ys"), F.array((F.col("k") % 3).cast("int")).alias("folds")).repartition(5))
    shape = R.design(rows, ("x", "z"))
    w = R.fit_many(rows, shape, [R.Fit(), R.Fit(0, ((0, 1),)), R.Fit(0, (), 50.0)])
    for k, (part, ridge) in enumerate(((df, 1.0), (df.where("k % 3 <> 1"), 1.0), (df, 50.0))):
        scaled = part.select("y", *(((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(("x", "z"), shape.center, shape.scale, strict=True)))
        # Spark weighs the penalty against the mean loss
        one = LogisticRegression(labelCol="y", regParam=ridge / part.count(), standardization=False, tol=1e-12, maxIter=200).fit(VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(scaled))
        assert w[:, k] == pytest.approx([*one.coefficients, one.intercept], abs=1e-4)


def test_refit_null_finds_a_planted_signal(spark):
    strong = R.refit_null(frame(spark, planted(800, 2, 1.2)), ("x", "z", "same"), ("k",), seeds=8, folds=4).first()
    assert strong["true_auc"] > 0.7 and strong["n_refits"] == 8
    assert abs(strong["null_mean"] - 0.5) < 0.05 and strong["z"] > 3
    none = R.refit_null(frame(spark, planted(800, 3, 0.0)), ("x", "z"), ("k",), seeds=8, folds=4).first()
    assert abs(none["z"]) < 3.5 and none["true_auc"] < 0.6


def test_random_search_repeats_and_differs_by_fold(spark):
    df = frame(spark, planted(500, 4, 1.0))
    runs = []
    for parts in (3, 7):
        search = R.Search(draws=6, inner=3)
        got = {x.k: (x.fold, x.p) for x in R.nested_search(df.repartition(parts), ("x", "z"), "k", 3, 2, search).collect()}
        runs.append((got, search.chosen))
    assert runs[0][1] == runs[1][1] and set(runs[0][1]) == {(r, k) for r in range(2) for k in range(3)}
    assert {k: f for k, (f, _) in runs[0][0].items()} == {k: f for k, (f, _) in runs[1][0].items()}
    assert all(runs[0][0][k][1] == pytest.approx(runs[1][0][k][1], abs=1e-6) for k in range(500))
    draws = {at: tuple(R.Search().sample(*at)) for at in runs[0][1]}
    assert len(set(draws.values())) == len(draws) and all(1e-3 <= x <= 1e3 for d in draws.values() for x in d)
    y = {x[0]: x[4] for x in planted(500, 4, 1.0)}
    pairs = [(runs[0][0][i][1], runs[0][0][j][1]) for i in y if y[i] for j in y if not y[j]]
    assert np.mean([(a > b) + (a == b) / 2 for a, b in pairs]) > 0.65


def test_binned_auc_equals_ranks():
    counts = np.array([[3, 0, 2, 1], [0, 1, 2, 4]], float)
    no, yes = ([b for b, n in enumerate(c) for _ in range(int(n))] for c in counts)
    want = np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])
    assert R._auc(counts) == pytest.approx(want)
    assert R._auc(np.array([[1.0, 2.0], [0.0, 0.0]])) == 0.5


def test_arms_may_differ_by_depth_alone(spark):
    """The label is an exclusive or: one split cannot tell it, two can."""
    r = random.Random(5)
    rows = [(k, 2000 + k % 4, float(r.randint(0, 1)), float(r.randint(0, 1))) for k in range(800)]
    df = spark.createDataFrame([(*x, int(x[2] != x[3])) for x in rows], "entity long, yr long, a double, b double, y int").withColumn("flat", F.lit(0.5))
    long = G.candidate_search(df, {"deep": G.Arm(("a", "b"), {"maxDepth": 3}), "stump": G.Arm(("a", "b"), {"maxDepth": 1})}, [2002, 2003], ["entity"], "flat")
    got = {(x.arm, x.fold): (x.ap, x.gain) for x in G.arm_table(long).collect()}
    assert set(got) == {(a, f) for a in ("deep", "stump", "baseline") for f in (2002, 2003, -1)}
    assert got["deep", -1][0] > 0.99 > got["stump", -1][0] + 0.2
    assert got["deep", -1][1] == pytest.approx(got["deep", -1][0] - got["baseline", -1][0]) and got["baseline", 2002][1] == 0
