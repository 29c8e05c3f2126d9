from pyspark.sql import functions as F

from panelyard import registry
from panelyard.operators import splits as S
from panelyard.operators import triage as H
from panelyard.plans import fixtures as fx
from panelyard.plans import triage_queries as Q


def test_battery_holds_every_check(spark, sf_dir, monkeypatch):
    """All checks of the method, equal to the queries they are taken from, from one pass over the line items."""
    run = lambda name: registry.QUERIES[name](spark, sf_dir).collect()
    alone = {f"horizon_{x.horizon}": (x.ap, x.n, x.ap < x.prevalence) for x in run("horizon_sweep")}
    alone |= {f"delay_{x.delay}": (x.ap, x.n, x.ap < x.prevalence) for x in run("reporting_delay_stress")}
    alone |= {"unseen_places" if x.unseen else "seen_places": (x.ap, x.n, False) for x in run("spatial_holdout")}
    regions = run("leave_group_out")
    passes, inner = [], fx.lines
    monkeypatch.setattr(fx, "lines", lambda *a, **k: passes.append(1) or inner(*a, **k))
    got = {x.check: (x.value, x.n, x.alarm) for x in run("validation_battery")}
    assert len(passes) == 1
    assert {"horizon_2", "horizon_4", "horizon_8", "delay_0", "delay_1", "delay_2", "seen_places", "unseen_places"} == set(alone)
    assert {k: got[k] for k in alone} == alone
    assert abs(got["group_out_mean"][0] - sum(x.ap for x in regions) / len(regions)) < 2e-6 and got["group_out_mean"][1] == sum(x.n for x in regions)
    assert set(got) == set(alone) | {"temporal_holdout", "temporal_accuracy", "rolling_mean", "rolling_worst", "group_out_mean", "shuffled_control", "leakage"}
    test = Q.scored(spark, sf_dir).where("yr > 1999").select("p3", "thr", "y").collect()
    right = sum((x.p3 >= x.thr / 2) == (x.y == 1) for x in test)
    assert abs(got["temporal_accuracy"][0] - right / len(test)) < 2e-6 and got["temporal_accuracy"][1] == len(test)


def test_leakage(spark):
    """A panel without gaps agrees on all rows; a gap costs those whose lag crosses it; a feature that never agrees raises the alarm."""
    def panel(weeks):
        df = spark.createDataFrame([(1, w, w * w + 1) for w in weeks], "entity long, w int, cases long")
        return df.select("entity", F.date_add(F.lit("2024-01-01").cast("date"), F.col("w") * 7).alias("week_start"), "cases", *(F.lit(0.0).alias(c) for c in ("a_sum", "b_mean", "c_mean")))

    whole, gap = Q.leakage(panel(range(20))).first(), Q.leakage(panel([w for w in range(20) if w != 9])).first()
    assert (whole["value"], whole["n"], whole["alarm"]) == (1.0, 20, False)
    # the lag of 8 is a week off in weeks 10 to 17: the eighth row before is nine weeks back, for week 17 the week by date is missing
    assert (gap["n"], gap["alarm"]) == (19, False) and abs(gap["value"] - 11 / 19) < 1e-12
    ahead = panel(range(20)).withColumn("past", F.lag("cases").over(S.DEFAULT.w)).withColumn("future", F.lead("cases").over(S.DEFAULT.w))
    assert S.leakage_audit(ahead, [("past", "past"), ("future", "past")]).first().share_equal == 0.0


def test_battery_parts(spark):
    """A result with parts gives a row for each that has a value."""
    many = spark.createDataFrame([(2, 0.5, 3, True), (4, None, 0, False)], "part int, value double, n long, alarm boolean")
    rows = H.validation_battery({"one": many.where("part = 2").drop("part"), "many": many}).collect()
    assert sorted(map(tuple, rows)) == [("many_2", 0.5, 3, True), ("one", 0.5, 3, True)]
