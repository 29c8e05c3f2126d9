"""Split, metric and bootstrap queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelyard.operators import bootstrap as B
from panelyard.operators import metrics as M
from panelyard.operators import splits as S
from panelyard.plans import fixtures as fx
from panelyard.plans.base import LAB, SCALED, query, scaled, scored
from panelyard.plans.feature_queries import W, contaminated_lags

SC = LAB + SCALED
FOLD_DRAWS, DRAWS = B.FOLD_DRAWS, B.CLUSTER_DRAWS


def one(df):
    return df.withColumn("one", F.lit(1))


def p3(spark: SparkSession, sf: str):
    return scored(spark, sf).withColumn("p", F.col("p3"))


def p1(spark: SparkSession, sf: str):
    return scored(spark, sf).withColumn("p", F.col("p1"))


def auc_sql(rows: str, keys: str = "", y: str = "y", p: str = "p", weight: str = "1") -> str:
    """ROC AUC and average precision by distinct scores for each key."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {k}coalesce(sum(CASE WHEN pos_all > 0 THEN pos / pos_all * tp / nullif(fl, 0) END), 0.0::DOUBLE) ap,
      sum(pos * ((n_all - pos_all) - (fl - tp) + (n - pos) / 2)) / nullif(max(pos_all) * (max(n_all) - max(pos_all)), 0) roc_auc
    FROM (SELECT *, sum(pos) OVER ({part}ORDER BY s DESC) tp, sum(n) OVER ({part}ORDER BY s DESC) fl, sum(pos) OVER ({part}) pos_all, sum(n) OVER ({part}) n_all
      FROM (SELECT {k}{p} s, sum({weight} * {y})::DOUBLE pos, sum({weight})::DOUBLE n FROM {rows} WHERE {p} IS NOT NULL AND {y} IS NOT NULL GROUP BY {k}{p})) {group})"""


def scores_sql(rows: str, keys: str) -> str:
    return f"SELECT * FROM (SELECT {keys}, count(*) n, sum(y) positives, avg(y) prevalence FROM {rows} GROUP BY {keys}) JOIN {auc_sql(rows, keys)} USING ({keys})"


def confusion_sql(flag: str, keys: str = "", extra: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}count(*) FILTER ({flag} AND y = 1) tp, count(*) FILTER (NOT {flag} AND y = 1) fn, count(*) FILTER ({flag} AND y = 0) fp, count(*) FILTER (NOT {flag} AND y = 0) tn{extra}"


def rates_sql(inner: str, more: str = "") -> str:
    d = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
    r, sp = d("tp", "tp + fn"), d("tn", "tn + fp")
    return f"SELECT *, {r} recall, {d('tp', 'tp + fp')} \"precision\", {sp} specificity, {d('tn', 'tn + fn')} npv, {d('tp + tn', 'tp + fn + fp + tn')} accuracy, ({r} + {sp}) / 2 balanced_accuracy{more} FROM ({inner})"


RATES = "recall precision specificity npv accuracy balanced_accuracy"
COUNTS = "tp fn fp tn"
CURVE = """(SELECT *, sum(pos) OVER (ORDER BY s DESC) tp, sum(n) OVER (ORDER BY s DESC) fl, sum(pos) OVER () pos_all, sum(n) OVER () n_all FROM (SELECT {p} s, sum(y)::DOUBLE pos, count(*)::DOUBLE n FROM {rows} GROUP BY 1))"""


def sens_sql(rows: str, p: str, target) -> str:
    return f"SELECT coalesce(max(CASE WHEN pos_all > 0 AND tp / pos_all >= {target} THEN s END), 0.0::DOUBLE) FROM {CURVE.format(p=p, rows=rows)}"


def quantiles(n: int, lo: float = 0.0, hi: float = 1.0) -> list[float]:
    return [round(lo + (hi - lo) * k / (n - 1), 6) for k in range(n)]


F1_GRID, POLICY_GRID = quantiles(40, 0.5, 0.999), quantiles(50)


def grid_sql(rows: str, p: str, shares: list[float]) -> str:
    return f"(SELECT DISTINCT unnest(quantile_cont({p}, [{', '.join(map(repr, shares))}])) t FROM {rows})"


def at_grid(rows: str, p: str, shares: list[float]) -> str:
    return f"(SELECT t, count(*) FILTER ({p} >= t) fl, count(*) FILTER ({p} >= t AND y = 1) tp, sum(y) pos_all, count(*) n_all FROM {rows}, {grid_sql(rows, p, shares)} GROUP BY t)"


def draws_sql(rows: str, cluster: str, draws: int) -> str:
    """Clusters drawn by the md5 of draw and place."""
    return f"""(SELECT draw, {cluster}, count(*) times FROM (SELECT draw, ids[(('0x' || substr(md5(draw || '-' || pos), 1, 8))::BIGINT % len(ids) + 1)::INT] {cluster}
      FROM (SELECT draw, unnest(range(len(ids))) pos, ids FROM (SELECT unnest(range(1, {draws + 1})) draw, ids FROM (SELECT list_sort(list(DISTINCT {cluster})) ids FROM {rows})))) GROUP BY 1, 2)"""


ARMS = """, arms AS (SELECT entity, yr, y, 'base' arm, p1 p FROM scored UNION ALL SELECT entity, yr, y, 'cand', p3 FROM scored)
"""
FOLD_DELTA = ARMS + f""", fold_ap AS (SELECT * FROM {auc_sql('arms', 'yr, arm')}),
deltas AS (SELECT yr fold, max(CASE WHEN arm = 'cand' THEN ap END) - max(CASE WHEN arm = 'base' THEN ap END) delta FROM fold_ap GROUP BY 1),
fold_boot AS (SELECT (SELECT avg(delta) FROM deltas) delta, (SELECT count(*) FROM deltas) n_folds, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high
  FROM (SELECT draw, sum(times * delta) / sum(times) m FROM {draws_sql('deltas', 'fold', FOLD_DRAWS)} JOIN deltas USING (fold) GROUP BY 1))
"""
CLUSTER = ARMS + f""", weighted AS (SELECT a.*, draw, times FROM arms a JOIN {draws_sql('scored', 'entity', DRAWS)} d USING (entity)),
both_classes AS (SELECT draw FROM weighted GROUP BY 1 HAVING min(y) < max(y)),
draw_ap AS (SELECT * FROM {auc_sql('weighted', 'draw, arm', weight='times')} JOIN both_classes USING (draw)),
own_ap AS (SELECT * FROM {auc_sql('arms', 'arm')}),
cluster_boot AS (SELECT (SELECT max(CASE WHEN arm = 'cand' THEN ap END) - max(CASE WHEN arm = 'base' THEN ap END) FROM own_ap) delta, quantile_cont(d, 0.025) ci_low, quantile_cont(d, 0.975) ci_high
  FROM (SELECT draw, max(CASE WHEN arm = 'cand' THEN ap END) - max(CASE WHEN arm = 'base' THEN ap END) d FROM draw_ap GROUP BY 1))
"""


def scores_of(rows):
    from panelyard.operators.triage import arms

    return M.average_precision(arms(rows, {"base": "p1", "cand": "p3"}, ["yr"]), ["yr", "arm"])


def fold_scores(spark, sf):
    return scores_of(scored(spark, sf))


def deltas_of(rows):
    gap = F.max(F.when(F.col("arm") == "cand", F.col("ap"))) - F.max(F.when(F.col("arm") == "base", F.col("ap")))
    return scores_of(rows).groupBy(F.col("yr").alias("fold")).agg(gap.alias("delta"))


def fold_deltas(spark, sf):
    return deltas_of(scored(spark, sf))


def ships(spark, sf):
    rows = scored(spark, sf)
    return B.ship_rule(B.paired_fold_bootstrap(deltas_of(rows), FOLD_DRAWS), B.cluster_bootstrap_compare(rows, "entity", DRAWS, "p1", "p3"))


def both_forms(spark, sf):
    rows = p3(spark, sf)
    return M.average_precision(rows, ["yr"]).join(M.rank_average_precision(rows, ["yr"], [F.col("entity"), F.col("week_start")]), "yr")


def yearly(rows):
    return M.confusion_at_threshold(rows, F.col("thr") / 2, ["yr"]).join(S.scores_by(rows, ["yr"]).drop("n"), "yr")


def points(rows):
    half = M.confusion_at_threshold(rows, 0.5).withColumns({"point": F.lit("half"), "threshold": F.lit(0.5)})
    best = F.broadcast(M.best_balanced_threshold(one(rows), ["one"]).select("threshold"))
    return half.unionByName(M.confusion_at_threshold(rows.crossJoin(best), F.col("threshold"), ["threshold"]).withColumn("point", F.lit("balanced")))


def split3(spark, sf):
    return S.temporal_split(p3(spark, sf), 1998, 1999)


def sweep(spark, sf):
    rows = split3(spark, sf)
    return M.operating_point_sweep(rows.where("split = 'val'"), rows.where("split = 'test'"), (0.5, 0.6, 0.7, 0.8, 0.9))


def budgets(spark, sf):
    rows = split3(spark, sf)
    return M.budget_sweep(rows.where("split = 'val'"), rows.where("split = 'test'"), range(1, 9), "week_start")


KTH = "(SELECT per_week, CASE WHEN k >= n THEN low ELSE (SELECT p3 FROM {v} ORDER BY p3 DESC LIMIT 1 OFFSET (k - 1)) END threshold FROM ks)"


def errors(spark, sf):
    rows = p3(spark, sf)
    cuts_ = M.quantile_row(rows, ("inc", "a_sum"), [0.25, 0.5, 0.75])
    rows = rows.crossJoin(F.broadcast(cuts_.withColumnsRenamed({c: f"q_{c}" for c in cuts_.columns})))
    bucket = lambda c: F.size(F.filter(f"q_{c}", lambda e: e <= F.col(c)))
    return M.strata(rows, {"quarter": F.quarter("week_start"), "incidence": bucket("inc"), "exposure": bucket("a_sum")}, F.col("p3") >= F.col("thr") / 2)


DOC = """, doc AS (SELECT d.doc_id, quality y, toxic, n_chars::DOUBLE n_chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE spaces, (length(text) - length(replace(text, chr(10), '')))::DOUBLE lines,
   length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE digits, (doc_id % 7)::DOUBLE noise FROM documents d JOIN labels l USING (doc_id))
"""
DOC_COLUMNS = ("n_chars", "spaces", "lines", "digits", "noise")


def docs(spark, sf):
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    gone = lambda p: F.length("text") - F.length(F.regexp_replace("text", p, ""))
    return d.select(
        "doc_id", F.col("quality").alias("y"), "toxic", F.col("n_chars").cast("double").alias("n_chars"), gone(" ").cast("double").alias("spaces"), gone("\n").cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), (F.col("doc_id") % 7).cast("double").alias("noise"),
    )


def melt_sql(rows: str, columns) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{c}' feature, {c} \"value\", y FROM {rows}" for c in columns) + ")"


SINGLE = DOC + f""", molten AS (SELECT * FROM {melt_sql('doc', DOC_COLUMNS)}),
single AS (SELECT feature, n, greatest(roc_auc, 1 - roc_auc) auc FROM {auc_sql('molten', 'feature', p='"value"')} JOIN (SELECT feature, count(*) n FROM molten GROUP BY 1 HAVING count(*) >= 20 AND min(y) < max(y)) USING (feature)),
ranges AS (SELECT *, min0 <= max1 AND min1 <= max0 "overlaps" FROM (SELECT feature, min("value") FILTER (y = 0) min0, max("value") FILTER (y = 0) max0, min("value") FILTER (y = 1) min1, max("value") FILTER (y = 1) max1
  FROM molten GROUP BY 1 HAVING count(*) FILTER (y = 0) >= 5 AND count(*) FILTER (y = 1) >= 5))
"""
RELIABILITY = SC + f""", edges AS (SELECT list_sort(list_distinct(quantile_cont(p, [{', '.join(repr(k / 15) for k in range(16))}]))) e FROM scaled),
rel AS (SELECT bin, count(*) n, avg(p) mean_p, avg(y) mean_y FROM (SELECT p, y, len(list_filter(e[2:len(e) - 1], lambda x: x <= p)) bin FROM scaled, edges) GROUP BY 1)
"""


def region_rows(spark, sf):
    return p3(spark, sf).drop("n_regionkey"), fx.meta(spark, sf).select("entity", F.col("n_regionkey").alias("region"))


def cuts(spark, sf):
    thr = fx.with_threshold(fx.panel(spark, sf)).select("thr").limit(1)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in (("low", 0.5), ("mid", 1.0), ("high", 1.5)))))
    return thr.select("thr", each.alias("s")).select(F.col("s.n").alias("threshold_name"), (F.col("thr") * F.col("s.m")).alias("cut"))


def policies(spark, sf):
    rows = p3(spark, sf)
    a = M.alert_policy_global(rows, POLICY_GRID, "week_start").select(F.lit("global").alias("policy"), F.col("t").alias("setting"), "recall", "precision", "alerts_per_week")
    b = M.alert_policy_topk(rows, 14, "week_start", [F.col("entity")]).select(F.lit("topk").alias("policy"), F.col("k").cast("double").alias("setting"), "recall", "precision", "alerts_per_week")
    return a.unionByName(b)


POLICY = LAB + f""", wk_n AS (SELECT count(DISTINCT week_start) w, sum(y) pos_all FROM scored),
at_all AS (SELECT t, CASE WHEN pos_all > 0 THEN tp::DOUBLE / pos_all ELSE 0 END recall, CASE WHEN fl > 0 THEN tp::DOUBLE / fl ELSE 0 END "precision", fl::DOUBLE / (SELECT w FROM wk_n) alerts_per_week FROM {at_grid('scored', 'p3', POLICY_GRID)}),
rk AS (SELECT y, row_number() OVER (PARTITION BY week_start ORDER BY p3 DESC, entity) r FROM scored),
topk AS (SELECT k, CASE WHEN pos_all > 0 THEN tp::DOUBLE / pos_all ELSE 0 END recall, CASE WHEN fl > 0 THEN tp::DOUBLE / fl ELSE 0 END "precision", fl::DOUBLE / w alerts_per_week
  FROM (SELECT k, count(*) FILTER (r <= k) fl, count(*) FILTER (r <= k AND y = 1) tp FROM rk, (SELECT unnest(range(1, 15)) k) GROUP BY 1), wk_n WHERE k <= (SELECT max(r) FROM rk)),
pol AS (SELECT 'global' policy, t setting, recall, "precision", alerts_per_week FROM at_all UNION ALL SELECT 'topk', k, recall, "precision", alerts_per_week FROM topk)
"""
UNSEEN = "('0x' || substr(md5(entity::VARCHAR), 1, 1))::INT < 4"
SHUFFLED = LAB + """, sh AS (SELECT a.seed, a.p, b.y FROM (SELECT seed, p3 p, row_number() OVER (PARTITION BY seed ORDER BY entity, week_start) n FROM scored, (SELECT unnest(range(1, 6)) seed)) a
  JOIN (SELECT seed, y, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(seed || '-' || entity || '-' || week_start), 1, 8))::BIGINT, entity, week_start) n FROM scored, (SELECT unnest(range(1, 6)) seed)) b USING (seed, n))
"""
HORIZON = f""", hz AS (SELECT p, horizon, y FROM (SELECT p, unnest([{{'horizon': 2, 'y': y2}}, {{'horizon': 4, 'y': y4}}, {{'horizon': 8, 'y': y8}}], recursive := true) FROM (SELECT inc p, thr, {', '.join(f"CASE WHEN datediff('day', week_start, lead(week_start,{h}) OVER w) = {7 * h} THEN coalesce((lead(inc,{h}) OVER w >= thr)::INT, 0) END y{h}" for h in (2, 4, 8))} FROM hp WINDOW w AS ({W}))) WHERE y IS NOT NULL)
"""
FUTURE = f""", fut AS (SELECT *, CASE WHEN datediff('day', week_start, lead(week_start,2) OVER w) = 14 THEN lead(inc,2) OVER w END future FROM hp WINDOW w AS ({W})),
late AS (SELECT delay, (future >= thr)::INT y, p FROM (SELECT future, thr, unnest([{{'delay': 0, 'p': d0}}, {{'delay': 1, 'p': d1}}, {{'delay': 2, 'p': d2}}], recursive := true) FROM (SELECT future, thr, {', '.join(f"first(inc) OVER (PARTITION BY entity ORDER BY datediff('day', DATE '1970-01-01', week_start) RANGE BETWEEN {7 * k} PRECEDING AND {7 * k} PRECEDING) d{k}" for k in (0, 1, 2))} FROM fut)) WHERE future IS NOT NULL AND p IS NOT NULL)
"""
SCORE_D, SCORE_L = "prevalence ap roc_auc", "n positives"

QUERIES = [
    # splits and sweeps
    query("temporal_split", lambda s, d: S.temporal_split(fx.panel(s, d), 1998, 1999).select("entity", "week_start", "split"), "SELECT entity, week_start, CASE WHEN yr <= 1998 THEN 'train' WHEN yr <= 1999 THEN 'val' ELSE 'test' END split FROM panel"),
    query("rolling_origin", lambda s, d: S.rolling_origin(fx.panel(s, d), 1999).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("cases").alias("cases")), "SELECT fold, CASE WHEN yr = fold THEN 'test' ELSE 'train' END role, count(*) n, sum(cases) cases FROM panel JOIN (SELECT DISTINCT yr fold FROM panel WHERE yr <= 1999 AND yr > (SELECT min(yr) FROM panel)) ON yr <= fold GROUP BY 1, 2", longs="fold n cases"),
    query("spatial_holdout", lambda s, d: S.scores_by(S.spatial_holdout(p1(s, d)), ["unseen"]), scores_sql("hold", "unseen"), SCORE_D, SCORE_L, LAB + f", hold AS (SELECT *, {UNSEEN} unseen, p1 p FROM scored)"),
    query("leave_group_out", lambda s, d: S.leave_group_out(*region_rows(s, d), "y", "p"), scores_sql("reg", "region"), SCORE_D, SCORE_L + " region", LAB + ", reg AS (SELECT y, p3 p, n_regionkey region FROM scored)"),
    query("horizon_sweep", lambda s, d: S.horizon_sweep(fx.hot_panel(s, d), (2, 4, 8)), scores_sql("hz", "horizon"), SCORE_D, SCORE_L + " horizon", HORIZON),
    query("threshold_sweep", lambda s, d: S.threshold_sweep(fx.hot_panel(s, d), cuts(s, d), 2), scores_sql("ts", "threshold_name"), SCORE_D, SCORE_L, FUTURE + ", ts AS (SELECT nm threshold_name, inc p, (future >= thr * m::DOUBLE)::INT y FROM fut, (VALUES ('low', 0.5), ('mid', 1.0), ('high', 1.5)) v(nm, m) WHERE future IS NOT NULL)"),
    query("shuffled_label_control", lambda s, d: S.scores_by(S.shuffled_labels(p3(s, d), 5, ["entity", "week_start"]), ["seed"]), scores_sql("sh", "seed"), SCORE_D, SCORE_L + " seed", SHUFFLED),
    query("permutation_null", lambda s, d: S.permutation_null(p3(s, d), 5, ["entity", "week_start"]), f"SELECT *, (true_auc - null_mean) / nullif(null_sd, 0) z FROM (SELECT (SELECT roc_auc FROM {auc_sql('scored', p='p3')}) true_auc, avg(roc_auc) null_mean, stddev_pop(roc_auc) null_sd FROM {auc_sql('sh', 'seed')})", "true_auc null_mean null_sd z", ctes=SHUFFLED),
    query("reporting_delay_stress", lambda s, d: S.reporting_delay_stress(fx.hot_panel(s, d), (0, 1, 2), 2), f"SELECT *, 7 * (2 + delay) lead_days FROM ({scores_sql('late', 'delay')})", SCORE_D, SCORE_L + " delay lead_days", FUTURE),
    query("lag_contamination_check", contaminated_lags, f"SELECT count(*) n, avg((a IS NOT DISTINCT FROM b)::INT::DOUBLE) share_equal FROM (SELECT lag(cases) OVER ({W}) a, first(cases) OVER (PARTITION BY entity ORDER BY datediff('day', DATE '1970-01-01', week_start) RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) b FROM hp)", "share_equal"),
    query("stratified_folds", lambda s, d: S.stratified_folds(docs(s, d), "doc_id", "y", 5, 2).select("doc_id", "repeat", "fold"), "SELECT doc_id, repeat, (row_number() OVER (PARTITION BY repeat, y ORDER BY ('0x' || substr(md5(doc_id || '-' || repeat), 1, 8))::BIGINT, doc_id) - 1) % 5 fold FROM doc, (SELECT unnest([1, 2]) repeat)", longs="repeat fold", ctes=DOC),
    # metrics
    query("pos_weight", lambda s, d: M.pos_weight(p3(s, d), ["yr"]), "SELECT yr, count(*) FILTER (y = 0)::DOUBLE / greatest(count(*) FILTER (y = 1), 1) pos_weight FROM scored GROUP BY 1", "pos_weight", ctes=LAB),
    query("confusion_at_threshold", lambda s, d: M.confusion_at_threshold(p3(s, d), F.col("thr") / 2, ["yr"], week="week_start"), rates_sql(confusion_sql("p3 >= thr / 2", "yr", ", count(DISTINCT week_start) n_weeks FROM scored GROUP BY 1"), ", (tp + fp)::DOUBLE / greatest(n_weeks, 1) flagged_per_week"), RATES + " flagged_per_week", COUNTS, LAB),
    query("binary_report", lambda s, d: yearly(p3(s, d)).withColumns({"f1": M.share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "lift": F.col("ap") / F.nullif(F.col("prevalence"), F.lit(0.0)), "trivial_accuracy": F.greatest("prevalence", 1 - F.col("prevalence"))}), f"SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END f1, ap / nullif(prevalence, 0) lift, greatest(prevalence, 1 - prevalence) trivial_accuracy FROM ({rates_sql(confusion_sql('p3 >= thr / 2', 'yr', ' FROM scored GROUP BY 1'))}) JOIN (SELECT yr, sum(y) positives, avg(y) prevalence FROM scored GROUP BY 1) USING (yr) JOIN {auc_sql('scored', 'yr', p='p3')} USING (yr)", RATES + " f1 lift trivial_accuracy prevalence ap roc_auc", COUNTS + " positives", LAB),
    query("threshold_for_sensitivity", lambda s, d: M.threshold_for_sensitivity(one(p3(s, d)), ["one"], 0.9).select("threshold"), f"SELECT ({sens_sql('scored', 'p3', 0.9)}) threshold", "threshold", ctes=LAB),
    query("threshold_for_f1", lambda s, d: M.threshold_for_f1(p3(s, d), F1_GRID), f"SELECT t threshold, 2.0::DOUBLE * tp / (fl + pos_all) f1 FROM {at_grid('scored', 'p3', F1_GRID)} ORDER BY f1 DESC, t DESC LIMIT 1", "threshold f1", ctes=LAB),
    query("best_balanced_threshold", lambda s, d: M.best_balanced_threshold(one(p3(s, d)), ["one"]).drop("one"), f"SELECT s threshold, (tp / pos_all + ((n_all - pos_all) - (fl - tp)) / (n_all - pos_all)) / 2 balanced_accuracy FROM {CURVE.format(p='p3', rows='scored')} ORDER BY 2 DESC, 1 LIMIT 1", "threshold balanced_accuracy", ctes=LAB),
    query("average_precision", both_forms, f"SELECT yr, ap, ap_rank FROM {auc_sql('scored', 'yr', p='p3')} JOIN (SELECT yr, sum(CASE WHEN y = 1 THEN tp::DOUBLE / n END) / sum(y) ap_rank FROM (SELECT yr, y, row_number() OVER o n, sum(y) OVER (PARTITION BY yr ORDER BY p3 DESC, entity, week_start ROWS UNBOUNDED PRECEDING) tp FROM scored WINDOW o AS (PARTITION BY yr ORDER BY p3 DESC, entity, week_start)) GROUP BY 1) USING (yr)", "ap ap_rank", ctes=LAB),
    query("roc_auc", lambda s, d: M.roc_auc(p3(s, d), ["yr"]), f"SELECT yr, roc_auc FROM {auc_sql('scored', 'yr', p='p3')}", "roc_auc", ctes=LAB),
    query("brier_score", lambda s, d: M.brier_score(scaled(s, d), ["yr"]), "SELECT yr, avg(pow(p - y, 2)) brier FROM scaled GROUP BY 1", "brier", ctes=SC),
    query("expected_calibration_error", lambda s, d: M.expected_calibration_error(scaled(s, d)), "SELECT sum(n * abs(mean_y - mean_p)) / sum(n) ece FROM rel", "ece", ctes=RELIABILITY),
    query("reliability_table", lambda s, d: M.reliability_table(scaled(s, d)), "SELECT * FROM rel", "mean_p mean_y", "bin n", RELIABILITY),
    query("alerts_at_recall", lambda s, d: M.alerts_at_recall(p3(s, d), 0.7, "week_start"), rates_sql(confusion_sql("p3 >= threshold", "threshold", f", count(DISTINCT week_start) n_weeks FROM scored, (SELECT ({sens_sql('scored', 'p3', 0.7)}) threshold) GROUP BY 1"), ", (tp + fp)::DOUBLE / greatest(n_weeks, 1) flagged_per_week"), RATES + " threshold flagged_per_week", COUNTS, LAB),
    query("threshold_for_budget", lambda s, d: M.threshold_for_budget(p3(s, d), (0.5, 1, 2.5, 4), "week_start"), "SELECT per_week, k, CASE WHEN k >= n THEN low ELSE (SELECT p3 FROM (SELECT p3, row_number() OVER (ORDER BY p3 DESC) r FROM scored) WHERE r = k) END threshold FROM ks", "per_week threshold", "k", LAB + ", ks AS (SELECT b per_week, greatest(round_even(b * greatest(w, 1), 0)::BIGINT, 1) k, n, low FROM (SELECT count(*) n, count(DISTINCT week_start) w, min(p3) low FROM scored), (SELECT unnest([0.5::DOUBLE, 1, 2.5, 4]) b))"),
    query("top_k_by_week", lambda s, d: M.top_k_by_week(p3(s, d), 3, "week_start", [F.col("entity")]).select("entity", "week_start", "flag"), "SELECT entity, week_start, row_number() OVER (PARTITION BY week_start ORDER BY p3 DESC, entity) <= 3 flag FROM scored", ctes=LAB),
    query("operating_point_sweep", sweep, rates_sql(confusion_sql("p3 >= threshold", "target, threshold", f" FROM (SELECT * FROM scored WHERE yr > 1999), (SELECT target, coalesce(max(CASE WHEN pos_all > 0 AND tp / pos_all >= target THEN s END), 0.0::DOUBLE) threshold FROM {CURVE.format(p='p3', rows='val')}, (SELECT unnest([0.5::DOUBLE, 0.6, 0.7, 0.8, 0.9]) target) GROUP BY 1) GROUP BY 1, 2")), RATES + " target threshold", COUNTS, LAB + ", val AS (SELECT * FROM scored WHERE yr = 1999)"),
    query("budget_sweep", budgets, rates_sql(confusion_sql("p3 >= threshold", "per_week, threshold", ", avg(CASE WHEN p3 >= threshold AND y = 1 THEN weeks_to_crossing END) mean_lead FROM (SELECT * FROM scored WHERE yr > 1999), (SELECT per_week, CASE WHEN k >= n THEN low ELSE (SELECT p3 FROM (SELECT p3, row_number() OVER (ORDER BY p3 DESC) r FROM val) WHERE r = k) END threshold FROM ks) GROUP BY 1, 2")), RATES + " per_week threshold mean_lead", COUNTS, LAB + ", val AS (SELECT * FROM scored WHERE yr = 1999), ks AS (SELECT b per_week, greatest(round_even(b * greatest(w, 1), 0)::BIGINT, 1) k, n, low FROM (SELECT count(*) n, count(DISTINCT week_start) w, min(p3) low FROM val), (SELECT unnest(range(1, 9))::DOUBLE b))"),
    query("alert_policy_global", lambda s, d: M.alert_policy_global(p3(s, d), POLICY_GRID, "week_start"), "SELECT * FROM at_all", "t recall precision alerts_per_week", ctes=POLICY),
    query("alert_policy_topk", lambda s, d: M.alert_policy_topk(p3(s, d), 14, "week_start", [F.col("entity")]), "SELECT * FROM topk", "recall precision alerts_per_week", ctes=POLICY),
    query("cheapest_policy", lambda s, d: M.cheapest_policy(policies(s, d), 0.9), "SELECT policy, setting, recall, \"precision\", alerts_per_week FROM pol WHERE recall >= 0.9 QUALIFY row_number() OVER (PARTITION BY policy ORDER BY alerts_per_week, setting) = 1", "setting recall precision alerts_per_week", ctes=POLICY),
    query("fold_scores", fold_scores, "SELECT yr, arm, ap FROM fold_ap", "ap", ctes=LAB + FOLD_DELTA),
    query("paired_fold_bootstrap", lambda s, d: B.paired_fold_bootstrap(fold_deltas(s, d), FOLD_DRAWS), "SELECT * FROM fold_boot", "delta ci_low ci_high", ctes=LAB + FOLD_DELTA),
    query("cluster_bootstrap_ci", lambda s, d: B.cluster_bootstrap_ci(p3(s, d), "entity", DRAWS), "SELECT (SELECT ap FROM own_ap WHERE arm = 'cand') ap, quantile_cont(ap, 0.025) ci_low, quantile_cont(ap, 0.975) ci_high, count(*) n_draws FROM draw_ap WHERE arm = 'cand'", "ap ci_low ci_high", ctes=LAB + CLUSTER),
    query("cluster_bootstrap_compare", lambda s, d: B.cluster_bootstrap_compare(scored(s, d), "entity", DRAWS, "p1", "p3"), "SELECT *, (SELECT count(DISTINCT entity) FROM scored) n_folds, 'districts' unit, CASE WHEN ci_low > 0 THEN 'SHIP' WHEN ci_high < 0 THEN 'REGRESSION' ELSE 'noise' END verdict FROM cluster_boot", "delta ci_low ci_high", ctes=LAB + CLUSTER),
    query("ship_rule", ships, "SELECT f.delta fold_delta, f.ci_low fold_low, f.ci_high fold_high, c.delta cluster_delta, c.ci_low cluster_low, c.ci_high cluster_high, f.ci_low > 0 OR f.ci_high < 0 fold_significant, c.ci_low > 0 OR c.ci_high < 0 cluster_significant, f.ci_low > 0 AND c.ci_low > 0 ship FROM fold_boot f, cluster_boot c", "fold_delta fold_low fold_high cluster_delta cluster_low cluster_high", ctes=LAB + FOLD_DELTA + CLUSTER.replace(ARMS, "")),
    query("error_strata", errors, "SELECT stratum, bucket, tp + fn + fp + tn n, tp + fn outbreaks, recall, \"precision\", fn, fp FROM (" + rates_sql(confusion_sql("p3 >= thr / 2", "stratum, bucket", " FROM (SELECT *, unnest([{'stratum': 'quarter', 'bucket': quarter(week_start)::VARCHAR}, {'stratum': 'incidence', 'bucket': len(list_filter(qi, lambda x: x <= inc))::VARCHAR}, {'stratum': 'exposure', 'bucket': len(list_filter(qa, lambda x: x <= a_sum))::VARCHAR}], recursive := true) FROM scored, (SELECT quantile_cont(inc, [0.25, 0.5, 0.75]) qi, quantile_cont(a_sum, [0.25, 0.5, 0.75]) qa FROM scored)) GROUP BY 1, 2")) + ")", "recall precision", "n outbreaks fn fp", LAB),
    query("momentum_errors", lambda s, d: M.momentum_errors(p3(s, d), F.col("p3") >= F.col("thr") / 2, F.col("inc") >= F.col("thr") / 2), "SELECT avg((inc >= thr / 2)::INT::DOUBLE) FILTER (p3 >= thr / 2 AND y = 0) false_alarm_share, avg((inc >= thr / 2)::INT::DOUBLE) FILTER (p3 < thr / 2 AND y = 0) true_negative_share FROM scored", "false_alarm_share true_negative_share", ctes=LAB),
    query("single_feature_auc", lambda s, d: M.single_feature_auc(docs(s, d), DOC_COLUMNS), "SELECT * FROM single", "auc", ctes=SINGLE),
    query("range_overlap", lambda s, d: M.range_overlap(docs(s, d), DOC_COLUMNS), "SELECT * FROM ranges", "min0 max0 min1 max1", ctes=SINGLE),
    query("dataset_audit", lambda s, d: M.dataset_audit(docs(s, d), DOC_COLUMNS), "SELECT *, CASE WHEN leaky = '' AND disjoint = '' THEN 'PASS' ELSE 'REJECT' END verdict FROM (SELECT coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM single WHERE auc >= 0.95), '') leaky, coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM ranges WHERE NOT (min0 <= max1 AND min1 <= max0)), '') disjoint)", ctes=SINGLE),
    query("population_medians", lambda s, d: M.population_medians(docs(s, d), DOC_COLUMNS), f"SELECT {', '.join(f'quantile_cont({c}, 0.5) {c}' for c in DOC_COLUMNS)} FROM doc", " ".join(DOC_COLUMNS), ctes=DOC),
    query("screening_points", lambda s, d: points(scaled(s, d)), "SELECT 'half' point, 0.5::DOUBLE threshold, * FROM (" + rates_sql(confusion_sql("p >= 0.5", extra=" FROM scaled")) + ") UNION ALL SELECT 'balanced', threshold, * EXCLUDE (threshold) FROM (" + rates_sql(confusion_sql("p >= threshold", "threshold", f" FROM scaled, (SELECT s threshold FROM {CURVE.format(p='p', rows='scaled')} ORDER BY (tp / pos_all + ((n_all - pos_all) - (fl - tp)) / (n_all - pos_all)) / 2 DESC, 1 LIMIT 1) GROUP BY 1")) + ")", RATES + " threshold", COUNTS, SC),
    query("rank_average", lambda s, d: M.rank_average(scored(s, d), ["yr"], "p1", "p3").select("entity", "week_start", "rank_mean"), "SELECT entity, week_start, (rank() OVER (PARTITION BY yr ORDER BY p1) + (count(*) OVER (PARTITION BY yr, p1) - 1) / 2 + rank() OVER (PARTITION BY yr ORDER BY p3) + (count(*) OVER (PARTITION BY yr, p3) - 1) / 2) / 2 rank_mean FROM scored", "rank_mean", ctes=LAB),
]
