"""Model queries: fits with Spark ML, so row counts are what can be compared; formulas alone have SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions.scans import written
from panelyard.operators import calibration as C
from panelyard.operators import features as X
from panelyard.operators import labels as L
from panelyard.operators import metrics as M
from panelyard.operators import models as G
from panelyard.operators import refits as R
from panelyard.operators import splits as S
from panelyard.operators import triage as H
from panelyard.plans import fixtures as fx
from panelyard.plans.base import LAB, SCALED, query, scaled, scored
from panelyard.plans.feature_queries import PATIENTS, patients
from panelyard.plans.metric_queries import docs

COLUMNS = ("cases_lag1", "cases_roll4_mean", "growth1", "week_sin", "week_cos", "hist_rate", "a_sum_lag1")

#: Models train up to the year before and are tested from the year after.
VALIDATION_END = 1999
FOLDS, REPEATS = 3, 3
REFITS, REFIT_FOLDS = 10, 5


def rows(spark, sf):
    """Eligible labelled rows with a few features, the log peak and the weeks to crossing."""
    df = fx.hot_panel(spark, sf)
    for block in (X.lag_features, X.rolling_features, X.growth_ratios, X.seasonality, X.expanding_history):
        df = block(df)
    df = L.peak_incidence_target(L.weeks_to_crossing(L.emergence_label(df, keep_ineligible=True)))
    return df.select("entity", "week_start", "yr", "inc", "thr", "hot", "eligible", "y", "log_peak", "weeks_to_crossing", *(F.col(c).cast("double").alias(c) for c in COLUMNS))


def train_test(spark, sf):
    """Written once: every fit below reads these rows several times."""
    df = written(rows(spark, sf).where("eligible and y is not null"))
    return df.where("yr <= 1998"), df.where("yr >= 2000"), df


def keyed(df, *columns):
    return df.select("entity", "week_start", *columns)


def seed_ensemble(spark, sf):
    train, test, _ = train_test(spark, sf)
    return keyed(G.ensemble_score(G.seed_ensemble(train, COLUMNS, (1, 2)), test), "y", "p")


def fold_years(df):
    """Every year up to the end of validation that has earlier rows."""
    years = sorted(x["yr"] for x in df.select("yr").distinct().collect())
    return [y for y in years[1:] if y <= VALIDATION_END]


def oof(spark, sf):
    _, _, df = train_test(spark, sf)
    return G.oof_predictions(df, COLUMNS, fold_years(df))


def isotonic(spark, sf):
    found = written(oof(spark, sf))
    return keyed(G.isotonic_calibration(found, found), "p", "q")


def report(spark, sf):
    found = written(oof(spark, sf))
    return G.calibration_report(G.isotonic_calibration(found, found))


def blended(spark, sf):
    train, test, _ = train_test(spark, sf)
    return keyed(G.blend(train, test, COLUMNS), "y", "p")


def screening(spark, sf):
    d = written(docs(spark, sf).withColumn("h", S.hash_number(F.col("doc_id")) % 3))
    return G.screening_models(d.where("h > 0"), d.where("h = 0"), ("n_chars", "spaces", "lines", "digits")).select("doc_id", "model", "p")


def nested(spark, sf):
    """Each document's out-of-fold score, averaged over the repeats; ``fold`` is that of the first repeat."""
    return R.nested_search(docs(spark, sf), ("n_chars", "spaces", "lines"), "doc_id", FOLDS, REPEATS).select("doc_id", "fold", "p")


def refits(spark, sf):
    """Refits on permuted labels of the emergence rows."""
    _, _, df = train_test(spark, sf)
    return R.refit_null(df, COLUMNS, ("entity", "week_start"), REFITS, REFIT_FOLDS)


def platt(spark, sf):
    df = written(scaled(spark, sf))
    return keyed(G.sigmoid_calibration(df.where("yr <= 1998"), df.where("yr > 1998")), "p", "q")


def importance(spark, sf):
    train, _, _ = train_test(spark, sf)
    return G.feature_importance(G.seed_ensemble(train, COLUMNS, (1, 2)), COLUMNS, train)


def tweedie(spark, sf):
    train, test, _ = train_test(spark, sf)
    return keyed(G.tweedie_regression(train, test, COLUMNS, "log_peak"), "predicted")


def hazard(spark, sf):
    frame = written(L.hazard_frame(rows(spark, sf).withColumn("eligible", F.coalesce("eligible", F.lit(False)))))
    return G.hazard_model(frame.where("yr <= 1998"), frame.where("yr >= 2000"), COLUMNS, ("entity", "week_start"))


def information(spark, sf):
    train, test, _ = train_test(spark, sf)
    groups = {"history": ("cases_lag1", "cases_roll4_mean", "growth1", "hist_rate"), "season": ("week_sin", "week_cos", "a_sum_lag1"), "both": COLUMNS}
    return S.scores_by(G.ablation(train, test, groups, "inc"), ["group"])


def transfer(spark, sf):
    _, _, df = train_test(spark, sf)
    near, far = df.where("entity % 2 = 0"), df.where("entity % 2 = 1")
    return S.scores_by(G.transfer_eval(far, near.where("yr <= 1998"), near.where("yr >= 2000"), COLUMNS, "inc"), ["arm"])


def frontier(spark, sf, with_emergence: bool):
    """Scores of the last two weeks, the last row of each place."""
    panel = written(rows(spark, sf))
    going = L.continuation_label(panel, 2).where("yr <= 1998")
    risk = G.with_risk(panel.drop("y"), G.seed_ensemble(going, COLUMNS, (1,)), "continuation_risk")
    names = ["inc", "continuation_risk"]
    if with_emergence:
        quiet = panel.where("eligible and y is not null and yr <= 1998")
        risk = G.with_risk(risk, G.seed_ensemble(quiet, COLUMNS, (1,)), "emergence_risk", F.coalesce("eligible", F.lit(False)))
        names.append("emergence_risk")
    risk = risk.withColumn("currently_in_outbreak", F.col("hot") == 1)
    return H.latest_per_entity(risk, [*names, "currently_in_outbreak"])


def continuation_forecast(spark, sf):
    return frontier(spark, sf, False).withColumn("band", H.relative_bands(F.col("continuation_risk"), 0.4))


def dual_forecast(spark, sf):
    return H.assess_frame(frontier(spark, sf, True)).orderBy(F.desc_nulls_last("headline_risk"), "entity")


def candidates(spark, sf):
    """Arms that differ by features or by parameters alone; by fold and pooled, with the gain over the baseline."""
    _, _, df = train_test(spark, sf)
    arms = {"history": COLUMNS[:3], "all": COLUMNS, "all_shallow": G.Arm(COLUMNS, {"maxDepth": 1, "stepSize": 0.2})}
    return G.arm_table(written(G.candidate_search(df, arms, fold_years(df), ["entity"], "inc")))


def prepared_batch(spark, sf):
    cohort = patients(spark, sf)
    batch = cohort.withColumn("wbc", F.when(F.col("l_linenumber") != 2, F.col("wbc"))).drop("hct")
    filled, _ = C.batch_prepare(batch, cohort, ("plt", "wbc", "hct"), ("l_orderkey", "l_linenumber", "plt", "wbc", "hct"))
    return X.clinical_ratios(filled).select("l_orderkey", "l_linenumber", "wbc", "hct", "plt_wbc", "hct_plt")


STEPS = LAB + SCALED + f""", eg AS (SELECT list_sort(list_distinct(quantile_cont(p, [{', '.join(repr(k / 20) for k in range(1, 21))}]))) e FROM scaled),
bins AS (SELECT least(len(list_filter(e, lambda x: x < p)), len(e) - 1) bin, avg(y) m, max(p) upper FROM scaled, eg GROUP BY 1),
steps AS (SELECT upper, max(m) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) level FROM bins),
eps AS (SELECT coalesce(least(greatest(min(CASE WHEN g > 0 THEN g END) / 2, 1e-9), 1e-6), 1e-6) eps FROM (SELECT level - lag(level) OVER (ORDER BY level) g FROM (SELECT DISTINCT level FROM steps)))
"""

QUERIES = [
    query("seed_ensemble_fit", seed_ensemble),
    query("oof_predictions", lambda s, d: keyed(oof(s, d), "fold", "y", "p")),
    query("isotonic_calibration", isotonic),
    query("tie_broken_calibration", lambda s, d: keyed(C.tie_broken_calibration(scaled(s, d), C.step_table(scaled(s, d))), "q").withColumn("q", F.col("q") * 1000), "SELECT entity, week_start, least(greatest(coalesce((SELECT level FROM steps WHERE upper >= p ORDER BY upper LIMIT 1), (SELECT level FROM steps ORDER BY upper DESC LIMIT 1)) + eps * (0.5 + atan((p - q4[2]) / greatest(q4[3] - q4[1], 1e-12)) / pi()), 0), 1) * 1000 q FROM scaled, eps, (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) q4 FROM scaled)", "q", ctes=STEPS),
    query("apply_calibrator", lambda s, d: keyed(scored(s, d).withColumn("q", C.apply_calibrator(F.col("p3") / F.col("thr"))), "q"), "SELECT entity, week_start, least(greatest(p3 / thr, 0.0::DOUBLE), 1.0::DOUBLE) q FROM scored", "q", ctes=LAB),
    query("calibration_report", report),
    query("blend_fit_score", blended),
    query("screening_models", screening),
    query("nested_cv", nested),
    query("permutation_null_refit", refits),
    query("sigmoid_calibration", platt),
    query("feature_importance", importance),
    query("tweedie_regression", tweedie),
    query("hazard_model", hazard),
    query("batch_prepare", prepared_batch, "SELECT l_orderkey, l_linenumber, wbc, hct, plt / greatest(wbc, 1) plt_wbc, hct / greatest(plt / 1000, 1e-6) hct_plt FROM (SELECT l_orderkey, l_linenumber, plt, CASE WHEN l_linenumber <> 2 THEN wbc ELSE (SELECT quantile_cont(wbc, 0.5) FROM pat) END wbc, (SELECT quantile_cont(hct, 0.5) FROM pat) hct FROM pat)", "wbc hct plt_wbc hct_plt", "l_linenumber", PATIENTS),
    query("continuation_forecast", continuation_forecast),
    query("dual_forecast", dual_forecast),
    query("candidate_search", candidates),
    query("information_ablation", information),
    query("transfer_eval", transfer),
]
