"""Properties of features and labels on small hand-made and random panels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelyard.operators import features as X
from panelyard.operators import labels as L
from panelyard.operators import metrics as M
from panelyard.operators import triage as H

HOT, COLD = 20.0, 0.5


def panel(spark, rates, entity=1, threshold=10.0):
    start = dt.date(2020, 1, 6)
    rows = [(entity, start + dt.timedelta(weeks=k), int(r), float(r), 1000, float(k % 7), 25.0 + k % 5, 60.0, int(r >= threshold), threshold) for k, r in enumerate(rates)]
    return spark.createDataFrame(rows, "entity long, week_start date, cases long, inc double, population long, a_sum double, b_mean double, c_mean double, hot int, thr double")


def column(df, name):
    return [r[name] for r in df.orderBy("week_start").collect()]


def test_eligibility_needs_all_quiet_weeks(spark):
    assert column(L.eligible_mask(panel(spark, [HOT, COLD, COLD, COLD])), "eligible") == [False, False, False, True]


def test_weeks_since_counts_from_the_week_before(spark):
    assert column(X.weeks_since_event(panel(spark, [HOT, COLD, COLD, COLD])), "weeks_since_hot") == [100, 0, 1, 2]


def test_history_is_past_only(spark):
    got = column(X.expanding_history(panel(spark, [HOT, HOT, COLD, COLD])), "hist_hot_rate")
    assert got[0] is None and got[1:] == pytest.approx([1, 1, 2 / 3])


def test_label_looks_at_all_weeks_ahead(spark):
    rows = L.emergence_label(panel(spark, [COLD] * 4 + [HOT] + [COLD] * 3), horizon=3, keep_ineligible=True)
    assert column(rows, "y") == [0, 1, 1, 1, 0, None, None, None]
    assert column(L.weeks_to_crossing(rows, 3), "weeks_to_crossing") == [None, 3, 2, 1, None, None, None, None]


@pytest.mark.parametrize("cut", [30, 60])
def test_deleting_the_future_changes_nothing(spark, cut):
    r = random.Random(2)
    rates = [r.choice([COLD, 3.0, 8.0, HOT]) for _ in range(80)]
    whole, part = (X.feature_matrix(panel(spark, x)).orderBy("week_start").collect() for x in (rates, rates[:cut]))
    assert [str(x) for x in whole[:cut]] == [str(x) for x in part]


def test_susceptible_pool_equals_the_loop(spark):
    r = random.Random(8)
    rates = [r.choice([0, 5, 300, 90]) for _ in range(120)]
    d, m, want = 0.5 ** (1 / 156), 0.0, []
    before = 0.0
    for x in rates:
        m = min(1.0, m * d + before)
        want.append(1 - m)
        before = x * 4 / 1000
    assert column(X.susceptible_pool(panel(spark, rates)), "susceptible") == pytest.approx(want, abs=1e-12)


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "p double, y int").withColumn("one", F.lit(1))
    assert M.roc_auc(rows, ["one"]).first().roc_auc == pytest.approx((2 + 1 + 0.5) / 4)
    assert M.average_precision(rows, ["one"]).first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert M.threshold_for_sensitivity(rows, ["one"], 0.9).first().threshold == 0.8
    none = rows.withColumn("y", F.lit(0))
    assert M.threshold_for_sensitivity(none, ["one"], 0.9).first().threshold == 0.0
    assert M.average_precision(none, ["one"]).first().ap == 0.0


@pytest.mark.parametrize(("labels", "want"), [([0, 0, 0, 1], 3), ([0, 1], 1), ([0, 0], 2)])
def test_positive_weight(spark, labels, want):
    rows = spark.createDataFrame([(y,) for y in labels], "y int")
    assert M.pos_weight(rows, []).first().pos_weight == want


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", True, 0.8, None), ("b", False, None, None), ("c", False, None, 0.7), ("d", False, None, 0.2)], "entity string, currently_in_outbreak boolean, continuation_risk double, emergence_risk double")
    got = {r.entity: (r.triage, r.band, r.assessable) for r in H.assess_frame(rows).collect()}
    assert got == {"a": ("In outbreak", "Very High", True), "b": ("Not assessable", None, False), "c": ("Outbreak likely", "High", True), "d": ("Clear", "Low", True)}
    assert [r.n for r in H.triage_counts(H.assess_frame(rows.where("entity = 'a'"))).orderBy("place").collect()] == [1, 0, 0, 0]
