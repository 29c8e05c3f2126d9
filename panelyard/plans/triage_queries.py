"""Triage, serving and streaming queries with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scans import quantiles, written
from panelyard.operators import features as X
from panelyard.operators import labels as L
from panelyard.operators import metrics as M
from panelyard.operators import splits as S
from panelyard.operators import triage as H
from panelyard.plans import fixtures as fx
from panelyard.plans.base import LAB, query, scored, with_share
from panelyard.plans.metric_queries import FUTURE, HORIZON, SHUFFLED, UNSEEN, auc_sql, p3, scores_sql
from panelyard.streaming import incremental as I  # noqa: E741

W = "PARTITION BY entity ORDER BY week_start"
ADVICE = "CASE WHEN risk IS NULL AND flag THEN 'no outbreak forecast; confirm' WHEN risk IS NULL THEN 'no outbreak forecast; routine care' WHEN flag AND risk >= 0.5 THEN 'confirm and start vector control' WHEN flag THEN 'confirm' WHEN risk >= 0.5 THEN 'maintain surveillance' ELSE 'routine care' END"


def risks(spark, sf):
    """All panel rows with two risks between 0 and 1, the second only where a place is quiet."""
    rows = L.eligible_mask(fx.hot_panel(spark, sf))
    rows = X.naive_baselines(rows)
    rows = with_share(with_share(rows, "inc", "inc_share"), "moving_average", "moving_average_share")
    return rows.select(
        "entity", "week_start", "cases", "inc", (F.col("hot") == 1).alias("currently_in_outbreak"), F.col("inc_share").alias("continuation_risk"),
        F.when(F.col("eligible"), F.col("moving_average_share")).alias("emergence_risk"),
    )


RISKS = LAB + """, risks AS (SELECT entity, week_start, cases, inc, hot = 1 currently_in_outbreak, cume_dist() OVER (ORDER BY inc) continuation_risk,
  CASE WHEN eligible THEN cume_dist() OVER (ORDER BY p3) END emergence_risk FROM lab)
"""
BAND = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= 0.25 THEN 'Low' WHEN {c} <= 0.5 THEN 'Moderate' WHEN {c} <= 0.75 THEN 'High' ELSE 'Very High' END"
ASSESS = RISKS + f""", recent AS (SELECT * FROM risks WHERE week_start > (SELECT max(week_start) FROM risks) - INTERVAL 14 DAY),
latest AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY entity ORDER BY week_start DESC) = 1),
assessed0 AS (SELECT *, CASE WHEN currently_in_outbreak THEN 'In outbreak' WHEN emergence_risk IS NULL THEN 'Not assessable' WHEN emergence_risk >= 0.5 THEN 'Outbreak likely' ELSE 'Clear' END triage,
  CASE WHEN currently_in_outbreak THEN continuation_risk ELSE emergence_risk END headline_risk, currently_in_outbreak OR emergence_risk IS NOT NULL assessable,
  CASE WHEN currently_in_outbreak THEN 'already above the outbreak level' WHEN emergence_risk IS NULL THEN 'not quiet long enough to be asked' WHEN emergence_risk >= 0.5 THEN 'chance of crossing is 50% or more' ELSE 'chance of crossing is below 50%' END reason FROM latest),
assessed AS (SELECT *, {BAND.format(c='headline_risk')} band FROM assessed0)
"""
LATEST = ("cases", "inc", "currently_in_outbreak", "continuation_risk", "emergence_risk")
RISK_D = "inc continuation_risk emergence_risk"


def latest(spark, sf, fill: bool = False):
    return H.latest_per_entity(risks(spark, sf), LATEST, 2, fill)


def assessed(spark, sf):
    return H.assess_frame(latest(spark, sf))


def advice(spark, sf):
    people = fx.table(spark, sf, "customer").crossJoin(F.broadcast(quantiles(fx.table(spark, sf, "customer"), "c_acctbal", [0.5]).select(F.get("q", F.lit(0)).alias("m"))))
    patients = people.select("c_custkey", F.col("c_nationkey").cast("long").alias("area"), (F.col("c_acctbal") < F.col("m")).alias("flag"))
    areas = assessed(spark, sf).select(F.col("entity").alias("area"), F.col("headline_risk").alias("risk"))
    return H.case_area_advice(patients, areas).select("c_custkey", "area", "flag", "advice")


SCORES = {"model": "p3", "growth": "p2", "persistence": "p1"}
ARMS3 = ", arms3 AS (SELECT y, 'model' arm, p3 p FROM scored UNION ALL SELECT y, 'growth', p2 FROM scored UNION ALL SELECT y, 'persistence', p1 FROM scored)\n"


def leaderboard(spark, sf):
    return H.model_leaderboard(scored(spark, sf), SCORES, "persistence")


def lift(spark, sf):
    rows = p3(spark, sf)
    points = M.operating_point_sweep(rows.where("yr <= 1999"), rows.where("yr > 1999"), (0.5, 0.7, 0.9))
    return H.lift_over_trivial(points, rows.where("yr > 1999").agg(F.avg("y").alias("prevalence")))


LIFT = LAB + """, tr AS (SELECT * FROM scored WHERE yr <= 1999), te AS (SELECT * FROM scored WHERE yr > 1999),
cv AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) tp, sum(pos) OVER () pos_all FROM (SELECT p3 s, sum(y)::DOUBLE pos FROM tr GROUP BY 1)),
pts AS (SELECT target, threshold, count(*) FILTER (p3 >= threshold AND y = 1) tp, count(*) FILTER (p3 < threshold AND y = 1) fn, count(*) FILTER (p3 >= threshold AND y = 0) fp, count(*) FILTER (p3 < threshold AND y = 0) tn
  FROM te, (SELECT target, coalesce(max(CASE WHEN tp / pos_all >= target THEN s END), 0.0::DOUBLE) threshold FROM cv, (SELECT unnest([0.5::DOUBLE, 0.7, 0.9]) target) GROUP BY 1) GROUP BY 1, 2),
lifts AS (SELECT target, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END recall, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END "precision", CASE WHEN tn + fn > 0 THEN tn::DOUBLE / (tn + fn) ELSE 0 END npv,
  1 - (SELECT avg(y) FROM te) trivial_npv, 0.0::DOUBLE trivial_recall, 0.5::DOUBLE trivial_roc_auc FROM pts)
"""


def part(rows, column):
    return rows.select(F.col(column).cast("string").alias("part"), "y", "p")


def scored_groups(rows):
    """Rows (part, y, p) by what is scored."""
    ahead = rows.withColumn("p", F.col("p3"))
    return {
        "holdout": part(ahead.where("yr > 1999").withColumn("one", F.lit(1)), "one"),
        "year": part(ahead, "yr"),
        "unseen": part(S.spatial_holdout(rows.withColumn("p", F.col("p1"))), "unseen"),
        "seed": part(S.shuffled_labels(ahead, 5, ["entity", "week_start"]), "seed"),
    }


def scored_checks(scores):
    year, seed = scores["year"], scores["seed"]
    return {
        "temporal_holdout": scores["holdout"].select(F.col("ap").alias("value"), "n", (F.col("ap") < F.col("prevalence")).alias("alarm")),
        "rolling_mean": year.agg(F.avg("ap").alias("value"), F.sum("n").alias("n")).withColumn("alarm", F.lit(False)),
        "rolling_worst": year.agg(F.min("ap").alias("value"), F.count("*").alias("n")).withColumn("alarm", F.lit(False)),
        "unseen_places": scores["unseen"].where("part = 'true'").select(F.col("ap").alias("value"), "n", F.lit(False).alias("alarm")),
        "shuffled_control": seed.agg(F.avg("ap").alias("value"), F.count("*").alias("n"), (F.avg("ap") > 2 * F.avg("prevalence")).alias("alarm")),
    }


def battery(spark, sf):
    """The checks on scored rows, each group with a curve of its own; the query is ``whole_battery``."""
    return H.validation_battery(scored_checks({k: S.scores_by(g, ["part"]) for k, g in scored_groups(scored(spark, sf)).items()}))


LAGS = (1, 2, 4, 8)


def leakage(hot):
    """Stored lags and the stored mean of four weeks against the values by date. As in the reference, it alarms if one of them never agrees."""
    rows = X.rolling_features(X.lag_features(hot, lags=LAGS, exposure_lags=()), sizes=(4,))
    rows = X.date_exact_rolling(X.date_exact_lag(rows, "cases", LAGS), "cases", 4)
    pairs = [*((f"cases_lag{k}", f"cases_exact{k}") for k in LAGS), ("cases_roll4_mean", "cases_exact_mean4")]
    return S.leakage_audit(rows, pairs).select(F.col("share_equal").alias("value"), "n", (F.col("share_equal") == 0).alias("alarm"))


def whole_battery(spark, sf):
    """All checks, from one pass over the line items and one curve for all groups."""
    hot = written(fx.hot_panel(spark, sf))
    rows = scored(spark, sf, hot)
    ahead = rows.withColumn("p", F.col("p3"))
    groups = scored_groups(rows) | {"region": part(ahead, "n_regionkey"), "horizon": part(S.horizon_rows(hot, (2, 4, 8)), "horizon"), "delay": part(S.delayed_rows(hot, (0, 1, 2), 2), "delay")}
    tall = reduce(DataFrame.unionByName, (g.withColumn("group", F.lit(k)) for k, g in groups.items()))
    # a row for each part of a group
    found = written(S.scores_by(written(tall), ["group", "part"]))
    scores = {k: found.where(F.col("group") == k) for k in groups}
    half = M.confusion_at_threshold(ahead.where("yr > 1999").withColumn("one", F.lit(1)), F.col("thr") / 2, ["one"])
    each = lambda k: scores[k].select("part", F.col("ap").alias("value"), "n", (F.col("ap") < F.col("prevalence")).alias("alarm"))
    more = {
        "temporal_accuracy": half.select(F.col("accuracy").alias("value"), (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n"), F.lit(False).alias("alarm")),
        "seen_places": scores["unseen"].where("part = 'false'").select(F.col("ap").alias("value"), "n", F.lit(False).alias("alarm")),
        "group_out_mean": scores["region"].agg(F.avg("ap").alias("value"), F.sum("n").alias("n")).withColumn("alarm", F.lit(False)),
        "horizon": each("horizon"),
        "leakage": leakage(hot),
        "delay": each("delay"),
    }
    return H.validation_battery(scored_checks(scores) | more)


DAY = "PARTITION BY entity ORDER BY datediff('day', DATE '1970-01-01', week_start)"
FULL4 = "CASE WHEN count(cases) OVER ({f}) = 4 THEN avg(cases) OVER ({f}) END"
STORED = [f"lag(cases, {k}) OVER ({W})" for k in LAGS] + [FULL4.format(f=f"{W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING")]
ANEW = [f"first(cases) OVER ({DAY} RANGE BETWEEN {7 * k} PRECEDING AND {7 * k} PRECEDING)" for k in LAGS] + [FULL4.format(f=f"{DAY} RANGE BETWEEN 28 PRECEDING AND 7 PRECEDING")]
LEAKAGE = f""", leak AS (SELECT count(*) n, least({', '.join(f'avg((a{i} IS NOT DISTINCT FROM b{i})::INT::DOUBLE)' for i in range(len(STORED)))}) worst
  FROM (SELECT {', '.join(f'{a} a{i}, {b} b{i}' for i, (a, b) in enumerate(zip(STORED, ANEW, strict=True)))} FROM hp))
"""
BATTERY = LEAKAGE + f""", reg AS (SELECT y, p3 p, n_regionkey region FROM scored), hold AS (SELECT *, {UNSEEN} unseen, p1 p FROM scored), yrs AS (SELECT yr, ap, n FROM {auc_sql('scored', 'yr', p='p3')} JOIN (SELECT yr, count(*) n FROM scored GROUP BY 1) USING (yr)),
bat AS (SELECT 'temporal_holdout' "check", ap "value", (SELECT count(*) FROM scored WHERE yr > 1999) n, ap < (SELECT avg(y) FROM scored WHERE yr > 1999) alarm FROM {auc_sql('(SELECT * FROM scored WHERE yr > 1999)', p='p3')}
 UNION ALL SELECT 'rolling_mean', avg(ap), sum(n), false FROM yrs UNION ALL SELECT 'rolling_worst', min(ap), count(*), false FROM yrs
 UNION ALL SELECT 'unseen_places', ap, (SELECT count(*) FROM hold WHERE unseen), false FROM {auc_sql('hold', 'unseen')} WHERE unseen
 UNION ALL SELECT 'shuffled_control', avg(ap), count(*), avg(ap) > 2 * (SELECT avg(y) FROM scored) FROM {auc_sql('sh', 'seed')}
 UNION ALL SELECT 'temporal_accuracy', avg(((p3 >= thr / 2) = (y = 1))::INT), count(*), false FROM scored WHERE yr > 1999 HAVING count(*) > 0
 UNION ALL SELECT 'seen_places', ap, (SELECT count(*) FROM hold WHERE NOT unseen), false FROM {auc_sql('hold', 'unseen')} WHERE NOT unseen
 UNION ALL SELECT 'group_out_mean', avg(ap), sum(n), false FROM ({scores_sql('reg', 'region')}) HAVING count(*) > 0
 UNION ALL SELECT 'horizon_' || horizon, ap, n, ap < prevalence FROM ({scores_sql('hz', 'horizon')})
 UNION ALL SELECT 'leakage', worst, n, worst = 0 FROM leak WHERE n > 0
 UNION ALL SELECT 'delay_' || delay, ap, n, ap < prevalence FROM ({scores_sql('late', 'delay')}))
"""


def metric_change(spark, sf):
    """Average precision by year before (persistence) and after (moving average), later years only."""
    from panelyard.operators.triage import arms

    long = M.average_precision(arms(scored(spark, sf), {"before": "p1", "after": "p3"}, ["yr"]), ["yr", "arm"])
    named = lambda a: long.where(F.col("arm") == a).select(F.col("yr").cast("string").alias("task"), F.lit("ap").alias("metric"), F.col("ap").alias("value"))
    return H.metric_delta(named("before"), named("after").where("task > '1996'"))


def diff(spark, sf):
    return H.table_diff(fx.cases(spark, sf), fx.second_source(spark, sf), ["entity", "week_start"], ["cases"])


def coverage(spark, sf):
    rows = fx.cases(spark, sf)
    more = rows.unionByName(rows.where("entity = 3"))
    return H.key_coverage(more, fx.meta(spark, sf).where("entity <> 5").select("entity"))


def weekly_alert_board(spark, sf):
    """Places of the latest week by triage: history, eligibility, the week's highest scores and the verdict."""
    rows = X.expanding_history(X.weeks_since_event(fx.hot_panel(spark, sf)))
    flagged = M.top_k_by_week(rows.withColumn("p", F.col("inc")), 3, "week_start", [F.col("entity")]).select("entity", "week_start", "weeks_since_hot", "hist_rate", "flag")
    board = H.triage_board(assessed(spark, sf))
    return board.join(flagged, ["entity", "week_start"]).select("entity", "week_start", "triage", "place", "headline_risk", "band", "weeks_since_hot", "hist_rate", "flag")


def streamed(f):
    return lambda spark, sf: f(spark, sf, I.work_dir(spark))


# A file's rows are held against the watermark that closed weeks in the file before: the latest time of all files before that one, less the delay.
LATE = """, arrived AS (SELECT *, least(least(floor(((datediff('day', DATE '2024-01-01', ts::DATE) % 30 + 30) % 30) * 6 / 30)::INT, 5) + CASE WHEN event_id % 5 = 0 THEN (event_id // 5) % 4 ELSE 0 END, 5) file, date_trunc('week', ts)::DATE week_start FROM events),
upto AS (SELECT k, (SELECT max(ts) FROM arrived WHERE file <= k - 2) latest FROM (SELECT unnest(range(0, 6)) k)),
lates AS (SELECT delay, week_start, coalesce(week_start + INTERVAL 7 DAY <= date_trunc('milliseconds', latest) - span, false) late FROM arrived JOIN upto ON k = file, (VALUES ('1 hour', INTERVAL 1 HOUR), ('3 days', INTERVAL 3 DAY), ('14 days', INTERVAL 14 DAY)) v(delay, span))
"""
BOARD = ASSESS + f""", since AS (SELECT entity, week_start, hist_rate, flag, least(CASE WHEN mx IS NOT NULL THEN rn - mx ELSE 99 + rn END, 200) weeks_since_hot FROM (SELECT *, max(CASE WHEN prev = 1 THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING) mx
  FROM (SELECT *, coalesce(lag(hot) OVER w, 0) prev, row_number() OVER w rn, avg(inc) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hist_rate, row_number() OVER (PARTITION BY week_start ORDER BY inc DESC, entity) <= 3 flag FROM hp WINDOW w AS ({W}))))
"""

QUERIES = [
    query("risk_band", lambda s, d: risks(s, d).select("entity", "week_start", H.risk_band(F.col("emergence_risk")).alias("band")), f"SELECT entity, week_start, {BAND.format(c='emergence_risk')} band FROM risks", ctes=RISKS),
    query("assess_frame", assessed, "SELECT * FROM assessed", RISK_D + " headline_risk", ctes=ASSESS),
    query("triage_counts", lambda s, d: H.triage_counts(assessed(s, d)), "SELECT i - 1 place, g triage, count(a.entity) n FROM (SELECT unnest(['In outbreak', 'Outbreak likely', 'Clear', 'Not assessable']) g, unnest([1, 2, 3, 4]) i) LEFT JOIN assessed a ON a.triage = g GROUP BY 1, 2", longs="place", ctes=ASSESS),
    query("relative_bands", lambda s, d: risks(s, d).select("entity", "week_start", H.relative_bands(F.col("continuation_risk"), 0.4).alias("band")), "SELECT entity, week_start, CASE WHEN continuation_risk <= 0.2 THEN 'Low' WHEN continuation_risk <= 0.4 THEN 'Moderate' WHEN continuation_risk <= 0.7 THEN 'High' ELSE 'Very High' END band FROM risks", ctes=RISKS),
    query("latest_per_entity", latest, "SELECT * FROM latest", RISK_D, ctes=ASSESS),
    query("latest_per_entity_filled", lambda s, d: latest(s, d, True), "SELECT entity, max(week_start) week_start, arg_max(cases, week_start) cases, arg_max(inc, week_start) inc, arg_max(currently_in_outbreak, week_start) currently_in_outbreak, arg_max(continuation_risk, week_start) continuation_risk, arg_max(emergence_risk, week_start) FILTER (emergence_risk IS NOT NULL) emergence_risk FROM recent GROUP BY 1", RISK_D, ctes=ASSESS),
    query("entity_history_tail", lambda s, d: H.entity_history_tail(fx.cases(s, d), 160), "SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY entity ORDER BY week_start DESC) <= 160"),
    query("triage_board", lambda s, d: H.triage_board(assessed(s, d)).select("entity", "triage", "headline_risk", "place", "group_size"), "SELECT entity, triage, headline_risk, row_number() OVER (PARTITION BY triage ORDER BY headline_risk DESC NULLS LAST, entity) place, count(*) OVER (PARTITION BY triage) group_size FROM assessed", "headline_risk", ctes=ASSESS),
    query("case_area_advice", advice, f"SELECT c_custkey, area, flag, {ADVICE} advice FROM (SELECT c_custkey, c_nationkey::BIGINT area, c_acctbal < (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) flag, headline_risk risk FROM customer LEFT JOIN assessed ON entity = c_nationkey)", ctes=ASSESS),
    query("model_leaderboard", leaderboard, f"SELECT *, ap / nullif(baseline_ap, 0) lift, row_number() OVER (ORDER BY ap DESC, arm) \"rank\" FROM (SELECT *, (SELECT ap FROM {auc_sql('arms3', 'arm')} WHERE arm = 'persistence') baseline_ap FROM {auc_sql('arms3', 'arm')})", "ap roc_auc baseline_ap lift", ctes=LAB + ARMS3),
    query("lift_over_trivial", lift, "SELECT *, npv - trivial_npv npv_gain, row_number() OVER (ORDER BY recall DESC, target) = 1 best_recall FROM lifts", "target recall precision npv trivial_npv trivial_recall trivial_roc_auc npv_gain", ctes=LIFT),
    query("validation_battery", whole_battery, "SELECT * FROM bat", "value", "n", ctes=SHUFFLED + HORIZON + FUTURE + BATTERY),
    query("metric_delta", metric_change, f"SELECT yr::VARCHAR task, 'ap' metric, max(CASE WHEN arm = 'before' THEN ap END) \"before\", max(CASE WHEN arm = 'after' THEN ap END) \"after\", max(CASE WHEN arm = 'after' THEN ap END) - max(CASE WHEN arm = 'before' THEN ap END) delta FROM {auc_sql('ba', 'yr, arm')} WHERE yr > 1996 GROUP BY 1", "before after delta", ctes=LAB + ", ba AS (SELECT yr, y, 'before' arm, p1 p FROM scored UNION ALL SELECT yr, y, 'after', p3 FROM scored)"),
    query("table_diff", diff, "SELECT entity, week_start, 'cases' \"column\", a.cases::DOUBLE left_value, b.cases::DOUBLE right_value, CASE WHEN b.cases IS NULL THEN 'only_left' WHEN a.cases IS NULL THEN 'only_right' ELSE 'changed' END kind FROM cases a FULL JOIN second b USING (entity, week_start) WHERE a.cases IS DISTINCT FROM b.cases", "left_value right_value"),
    query("key_coverage", coverage, "SELECT entity, kind, count(*) n FROM (SELECT entity, 'missing' kind FROM (SELECT m.entity, w::DATE week_start FROM meta m, (SELECT unnest(generate_series(min(week_start)::TIMESTAMP, max(week_start)::TIMESTAMP, INTERVAL 7 DAY)) w FROM cases) WHERE m.entity <> 5) ANTI JOIN cases USING (entity, week_start) UNION ALL SELECT entity, 'undeclared' FROM cases WHERE entity = 5 UNION ALL SELECT entity, 'duplicate' FROM cases WHERE entity = 3) GROUP BY 1, 2"),
    query("weekly_alert_board", weekly_alert_board, "SELECT entity, week_start, triage, row_number() OVER (PARTITION BY triage ORDER BY headline_risk DESC NULLS LAST, entity) place, headline_risk, band, weeks_since_hot, hist_rate, flag FROM assessed JOIN since USING (entity, week_start)", "headline_risk hist_rate", "weeks_since_hot", BOARD),
    # streams
    query("stream_weekly_counts", streamed(I.stream_weekly_counts), "SELECT event_type, date_trunc('week', ts)::DATE week_start, count(*) n, sum(\"value\") total FROM events GROUP BY 1, 2", "total"),
    query("stream_dedup", streamed(I.stream_dedup), "SELECT DISTINCT user_id, event_type FROM events"),
    query("stream_upsert", lambda s, d: streamed(I.stream_upsert)(s, d).select("user_id", "event_id", "value"), "SELECT user_id, event_id, \"value\" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", "value"),
    query("stream_late_data", streamed(I.stream_late_data), "SELECT delay, count(DISTINCT week_start) FILTER (NOT late) AS weeks, count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS dropped FROM lates GROUP BY 1", ctes=LATE),
    query("stream_alerts", lambda s, d: I.stream_alerts(s, d, I.work_dir(s), F.col("value") >= 40), "SELECT event_id, event_type, \"value\" FROM events WHERE \"value\" >= 40", "value"),
]
