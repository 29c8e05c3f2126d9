"""Values of fitted models: against plain Python where there is a formula, by planted signals where there is none."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import models as G
from panelyard.operators.labels import hazard_combine
from panelyard.plans import model_queries as Q


def auc(pairs):
    yes, no = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows over four years: ``x`` tells the label, ``noise`` does not, some values are missing."""
    r = random.Random(11)
    made = []
    for k in range(600):
        x, noise = r.gauss(0, 1), r.gauss(0, 1)
        y = int(r.random() < 1 / (1 + math.exp(1 - 2.5 * x)))
        made.append((k, 1996 + k % 4, None if r.random() < 0.05 else x, noise, 0.5 * x + r.gauss(0, 1), y, 1.0 + x + 0.1 * noise))
    return spark.createDataFrame(made, "k long, yr long, x double, noise double, weak double, y int, log_peak double").cache()


COLUMNS = ("x", "noise")


def by_key(df, column="p"):
    return {x.k: x[column] for x in df.collect()}


def test_ensemble_is_the_mean_of_its_models(rows):
    train, test = rows.where("yr < 1999"), rows.where("yr = 1999")
    models = G.seed_ensemble(train, COLUMNS, (1, 2))
    both, one, two = (by_key(G.ensemble_score(m, test)) for m in (models, models[:1], models[1:]))
    assert all(both[k] == pytest.approx((one[k] + two[k]) / 2) for k in both) and one != two
    y = by_key(test, "y")
    assert auc([(p, y[k]) for k, p in both.items()]) > 0.8
    gains = G.feature_importance(models, COLUMNS, rows).collect()
    assert [g.feature for g in gains] == ["x", "noise"] and sum(g.gain for g in gains) == pytest.approx(2.0) and gains[0].gain > 1.4


def test_oof_uses_earlier_years_alone(rows):
    got = G.oof_predictions(rows, COLUMNS, [1997, 1999])
    assert {x.fold for x in got.select("fold").distinct().collect()} == {1997, 1999} and got.where("fold <> yr").isEmpty()
    again = by_key(G.ensemble_score(G.seed_ensemble(rows.where("yr < 1997"), COLUMNS, (1,)), rows.where("yr = 1997")))
    assert by_key(got.where("fold = 1997")) == pytest.approx(again)
    # labels of the fold and after it do not matter
    other = rows.withColumn("y", F.when(F.col("yr") >= 1997, 1 - F.col("y")).otherwise(F.col("y")))
    assert by_key(G.oof_predictions(other, COLUMNS, [1997])) == pytest.approx(again)


def violators(points):
    """Pooled means of (score, label) in the order of the score."""
    blocks = []
    for p, y in sorted(points):
        blocks.append([[p], y, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            scores, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + total, blocks[-1][2] + n]
    return {p: total / n for scores, total, n in blocks for p in scores}


def test_isotonic_equals_pooled_violators_and_report(spark):
    r = random.Random(3)
    points = [(k, k / 200, int(r.random() < (k / 200) ** 2)) for k in range(200)]
    df = spark.createDataFrame(points, "k long, p double, y int")
    got = G.isotonic_calibration(df, df)
    want = violators([(p, y) for _, p, y in points])
    assert by_key(got, "q") == pytest.approx({k: min(max(want[p], 0.001), 0.999) for k, p, _ in points})
    told = {x.score: x for x in G.calibration_report(got).collect()}
    for c in ("p", "q"):
        pairs = [(x[c], x.y) for x in got.collect()]
        assert told[c].n == 200 and told[c].brier == pytest.approx(np.mean([(p - y) ** 2 for p, y in pairs]))
        edges = sorted(set(np.quantile([p for p, _ in pairs], [k / 15 for k in range(16)])))
        place = np.digitize([p for p, _ in pairs], edges[1:-1])
        ece = sum(abs(sum(p - y for (p, y), b in zip(pairs, place, strict=True) if b == k)) for k in set(place)) / 200
        assert told[c].ece == pytest.approx(ece)
    assert told["q"].brier < told["p"].brier


def test_sigmoid_equals_newton(spark):
    r = random.Random(9)
    points = [(k, p := r.random(), int(r.random() < p**3)) for k in range(400)]
    df = spark.createDataFrame(points, "k long, p double, y int")
    x = np.array([[math.log(p / (1 - p)), 1.0] for _, p, _ in points])
    y, w = np.array([y for *_, y in points]), np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (y - q))
    want = 1 / (1 + np.exp(-x @ w))
    assert by_key(G.sigmoid_calibration(df, df), "q") == pytest.approx(dict(enumerate(want)), abs=2e-3)
    few = df.where("y = 0").unionByName(df.where("y = 1").limit(3))
    assert by_key(G.sigmoid_calibration(few, df), "q") == by_key(df)


def test_blend_mixes_classifier_and_bridge(rows):
    train, test = rows.where("yr < 1999"), rows.where("yr = 1999")
    both, first, second = (by_key(G.blend(train, test, COLUMNS, w)) for w in (0.5, 1.0, 0.0))
    assert both == pytest.approx({k: (first[k] + second[k]) / 2 for k in both})
    alone = by_key(G.probability(G.boosted(COLUMNS, 1).fit(G.weighted(train)).transform(test)))
    assert first == pytest.approx(alone) and all(1e-4 <= p <= 1 - 1e-4 for p in second.values())
    y = by_key(test, "y")
    assert auc([(p, y[k]) for k, p in second.items()]) > 0.75


def test_screening_models_find_the_signal(rows):
    train, test = rows.where("yr < 1999"), rows.where("yr = 1999")
    y = by_key(test, "y")
    for model in ("logistic", "boosted", "network"):
        got = by_key(G.screening_models(train, test, COLUMNS).where(F.col("model") == model))
        assert set(got) == set(y) and auc([(p, y[k]) for k, p in got.items()]) > 0.75


def test_tweedie_follows_a_log_linear_mean(spark):
    r = random.Random(2)
    points = [(k, x := r.uniform(-1, 1), math.exp(1 + 0.8 * x) * r.choice([0.0, 1.0, 2.0])) for k in range(900)]
    df = spark.createDataFrame(points, "k long, x double, target double")
    got = by_key(G.tweedie_regression(df, df, ("x",), "target"), "predicted")
    assert all(p > 0 for p in got.values())
    logs = np.array([math.log(got[k]) for k, *_ in points])
    slope, level = np.polyfit([x for _, x, _ in points], logs, 1)
    assert 0.2 < slope < 1.0 and abs(np.mean([math.exp(v) for v in logs]) / np.mean([t for *_, t in points]) - 1) < 0.1
    assert np.abs(logs - np.polyval([slope, level], [x for _, x, _ in points])).max() < 1e-6


def test_hazards_are_combined_to_risk(spark):
    r = random.Random(4)
    points = [(e, k, x := r.choice([-1.0, 1.0]), int(r.random() < (0.4 if x > 0 else 0.05))) for e in range(400) for k in (1, 2)]
    df = spark.createDataFrame(points, "e long, k int, x double, hazard_y int")
    risk = {x.e: x.risk for x in G.hazard_model(df, df.where("k = 1"), ("x",), ("e",)).collect()}
    single = G.probability(G.boosted(("x", "k"), 1, "hazard_y").fit(G.weighted(df, "hazard_y")).transform(df.where("k = 1")))
    assert risk == pytest.approx({x.e: x.p for x in single.collect()})
    both = {x.e: x.risk for x in hazard_combine(spark.createDataFrame([(1, 0.5), (1, 0.2), (2, 1.0), (2, 0.3)], "e long, p double"), ["e"]).collect()}
    assert both == pytest.approx({1: 0.6, 2: 1.0})


def test_ablation_and_transfer_tell_groups_apart(rows):
    train, test = rows.where("yr < 1999"), rows.where("yr = 1999")

    def scores(df, key):
        found = {}
        for x in df.collect():
            found.setdefault(x[key], []).append((x.p, x.y))
        return {k: auc(v) for k, v in found.items()}

    got = scores(G.ablation(train, test, {"signal": ("x",), "noise": ("noise",)}, "weak"), "group")
    assert set(got) == {"persistence", "signal", "noise"} and got["signal"] > got["persistence"] > got["noise"] - 0.05 and got["signal"] > got["noise"] + 0.2
    # a source population whose labels are turned round misleads
    turned = train.withColumn("y", 1 - F.col("y"))
    arms = scores(G.transfer_eval(turned, train, test, ("x",), "weak"), "arm")
    assert set(arms) == {"persistence", "zero_shot", "local"} and arms["local"] > 0.75 > 0.4 > arms["zero_shot"]


def test_risk_is_null_where_not_asked(rows):
    models = G.seed_ensemble(rows, COLUMNS, (1,))
    got = G.with_risk(rows, models, "risk", F.col("k") % 2 == 0).collect()
    assert all((x.risk is None) == (x.k % 2 == 1) for x in got)


def test_forecasts_follow_their_rules(spark, sf_dir):
    going = Q.continuation_forecast(spark, sf_dir).collect()
    assert going and all(x.band == ("Low" if x.continuation_risk <= 0.2 else "Moderate" if x.continuation_risk <= 0.4 else "High" if x.continuation_risk <= 0.7 else "Very High") for x in going)
    assert len({x.entity for x in going}) == len(going)
    dual = Q.dual_forecast(spark, sf_dir).collect()
    assert {x.entity: x.continuation_risk for x in dual} == pytest.approx({x.entity: x.continuation_risk for x in going})
    for x in dual:
        assert x.headline_risk == (x.continuation_risk if x.currently_in_outbreak else x.emergence_risk)
        assert (x.triage == "In outbreak") == x.currently_in_outbreak
    risks = [x.headline_risk for x in dual]
    assert risks == sorted(risks, key=lambda p: (p is None, -(p or 0)))
