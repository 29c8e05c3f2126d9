"""Feature, label and split queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelyard.operators import features as X
from panelyard.operators import labels as L
from panelyard.operators import splits as S
from panelyard.plans import fixtures as fx
from panelyard.plans.base import LAB, labelled, query, scored
from panelyard.plans.panel_queries import INDEX, index_rows

W = "PARTITION BY entity ORDER BY week_start"
WINDOW = f"WINDOW w AS ({W})"
PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def back(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def roll(c: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({c}) OVER {back(n)} = {n} THEN {f}({c}) OVER {back(n)} END"


def pick(df, *columns):
    return df.select("entity", "week_start", *columns)


def hp(spark: SparkSession, sf: str):
    return fx.hot_panel(spark, sf)


def pairs(spark: SparkSession, sf: str):
    return X.haversine_pairs(fx.meta(spark, sf))


KM = "greatest(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))), 25.0::DOUBLE)"
PAIRS = f""", pairs AS (SELECT *, pop_b / (km * km) weight FROM (SELECT a.entity, b.entity other, {KM} km, b.population pop_b FROM meta a JOIN meta b ON a.entity <> b.entity))
"""
FORCE = PAIRS + """, pushed AS (SELECT p.entity, h.week_start, sum(weight * inc) / 1e6 f FROM hp h JOIN pairs p ON p.other = h.entity WHERE hot = 1 GROUP BY 1, 2),
forced AS (SELECT entity, week_start, coalesce(f, 0) import_force FROM hp LEFT JOIN pushed USING (entity, week_start))
"""
ANOM = ", ".join(
    f"CASE WHEN count({c}) OVER y >= 4 AND stddev_samp({c}) OVER y > 1e-6 THEN least(greatest(({c} - avg({c}) OVER y) / stddev_samp({c}) OVER y, -6.0::DOUBLE), 6.0::DOUBLE) END {c}_anom" for c in ("a_sum", "b_mean")
)
ANOM = f""", anom AS (SELECT *, {ANOM} FROM hp WINDOW y AS (PARTITION BY entity, weekofyear(week_start) ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
DRY = ANOM + f""", q AS (SELECT *, quantile_cont(b_mean, 0.25) OVER {PAST} past_q, row_number() OVER ({W}) rn FROM anom),
dry AS (SELECT *, least(rn - coalesce(max(CASE WHEN NOT coalesce(b_mean < past_q, false) THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING), 0), 52) dry_run FROM q)
"""
DECAY = repr(0.5 ** (1 / 156.0))
POOL = f""", s0 AS (SELECT *, row_number() OVER ({W})::DOUBLE i, coalesce(lag(cases * 4.0::DOUBLE / greatest(population, 1)) OVER ({W}), 0.0::DOUBLE) a FROM hp),
s1 AS (SELECT *, pow({DECAY}::DOUBLE, i) * sum(a * pow({DECAY}::DOUBLE, -i)) OVER ({W} ROWS UNBOUNDED PRECEDING) s FROM s0),
pool AS (SELECT *, 1 - (s - greatest(pow({DECAY}::DOUBLE, i) * max(pow({DECAY}::DOUBLE, -i) * (s - 1)) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE)) susceptible FROM s1)
"""
SINCE = "least(CASE WHEN mx IS NOT NULL THEN rn - mx ELSE {start} + rn END, {cap})"


def dry_spell(spark, sf):
    rows = X.week_of_year_anomaly(hp(spark, sf), ["a_sum"])
    return pick(X.dry_spell_run(rows, "b_mean", "a_sum_anom"), "dry_run", "dry_then_wet")


def contaminated_lags(spark, sf):
    """A stored positional lag checked against the lag by date."""
    rows = X.lag_features(hp(spark, sf), lags=(1,), exposure_lags=())
    return S.lag_contamination_check(rows, "cases_lag1", "cases", 1)


def patients(spark, sf):
    """Blood counts made of the columns of line items, one row for each order line."""
    li = fx.table(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", (p / 10).alias("plt"), (q / 3).alias("wbc"), (q + 20).alias("neu"), (F.col("l_tax") * 400).alias("lym"),
        (F.col("l_discount") * 100).alias("mono"), (q / 5).alias("mpv"), (q / 4).alias("rdw"), (q + 10).alias("hct"),
    )


PATIENTS = """, pat AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 plt, l_quantity / 3 wbc, l_quantity + 20 neu, l_tax * 400 lym, l_discount * 100 mono,
  l_quantity / 5 mpv, l_quantity / 4 rdw, l_quantity + 10 hct FROM lineitem)
"""
RATIOS = {
    "plt_wbc": "plt / greatest(wbc, 1)", "nlr": "neu / greatest(lym, 1)", "plr": "plt / greatest(lym, 1)", "mpv_plt": "mpv / greatest(plt / 1000, 1e-6)", "neut_abs": "wbc * neu / 100",
    "lymph_abs": "wbc * lym / 100", "sii": "(wbc * neu / 100) * plt / greatest(wbc * lym / 100, 1)", "mono_abs": "wbc * mono / 100", "lmr": "lym / greatest(mono, 0.1::DOUBLE)",
    "plateletcrit": "plt * mpv / 1e4", "rdw_plt": "rdw / greatest(plt / 1000, 1e-6)", "hct_plt": "hct / greatest(plt / 1000, 1e-6)",
}


def settings(spark):
    """Three (horizon, threshold) settings in multiples of the panel's own threshold."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), F.lit(h).alias("horizon"), F.lit(m).alias("times")) for n, h, m in (("a", 4, 1.0), ("b", 2, 1.0), ("c", 4, 0.5))))).alias("s")).select("s.*")


def transitions(spark, sf):
    rows = fx.panel(spark, sf).select("entity", "week_start", "inc")
    return L.transition_labels(rows, cuts(spark, sf)).select("setting", "entity", "week_start", "y")


def cuts(spark, sf):
    """The settings with the threshold worked out: three rows."""
    cut = fx.with_threshold(fx.panel(spark, sf)).select("thr").limit(1)
    return settings(spark).crossJoin(F.broadcast(cut)).select("setting", "horizon", (F.col("thr") * F.col("times")).alias("threshold"))


TRANS = f""", st AS (SELECT * FROM (VALUES ('a', 4, 1.0), ('b', 2, 1.0), ('c', 4, 0.5)) v(setting, horizon, times)),
th AS (SELECT setting, horizon, entity, week_start, (inc >= thr * times::DOUBLE)::INT h FROM hp, st),
tl AS (SELECT *, coalesce(h = 0 AND lag(h,1) OVER w = 0 AND lag(h,2) OVER w = 0, false) eligible,
  CASE WHEN horizon = 4 AND count(h) OVER f4 = 4 AND datediff('day', week_start, lead(week_start,4) OVER w) = 28 THEN max(h) OVER f4
       WHEN horizon = 2 AND count(h) OVER f2 = 2 AND datediff('day', week_start, lead(week_start,2) OVER w) = 14 THEN max(h) OVER f2 END y
  FROM th WINDOW w AS (PARTITION BY setting, entity ORDER BY week_start), f4 AS (PARTITION BY setting, entity ORDER BY week_start ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
   f2 AS (PARTITION BY setting, entity ORDER BY week_start ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
"""


def lead_summary(spark, sf):
    return L.lead_times(scored(spark, sf).withColumn("flagged", F.col("p3") >= F.col("thr") / 2), "flagged")


def hazards(spark, sf):
    rows = L.eligible_mask(hp(spark, sf))
    return pick(L.hazard_frame(rows), "k", "hazard_y")


def combined_hazards(spark, sf):
    frame = L.hazard_frame(L.eligible_mask(hp(spark, sf))).withColumn("p", F.least(F.col("inc") / F.col("thr"), F.lit(1.0)) / (F.col("k") + 1))
    return L.hazard_combine(frame, ["entity", "week_start"])


HAZARD = f""", el AS (SELECT *, coalesce(hot = 0 AND lag(hot,1) OVER w = 0 AND lag(hot,2) OVER w = 0, false) eligible, lead(hot,1) OVER w h1, lead(hot,2) OVER w h2, lead(hot,3) OVER w h3, lead(hot,4) OVER w h4 FROM hp {WINDOW}),
hz AS (SELECT entity, week_start, inc, thr, 1 k, h1 hazard_y FROM el WHERE eligible AND h1 IS NOT NULL
  UNION ALL SELECT entity, week_start, inc, thr, 2, h2 FROM el WHERE eligible AND h2 IS NOT NULL AND coalesce(h1, 0) = 0
  UNION ALL SELECT entity, week_start, inc, thr, 3, h3 FROM el WHERE eligible AND h3 IS NOT NULL AND coalesce(h1, 0) = 0 AND coalesce(h2, 0) = 0
  UNION ALL SELECT entity, week_start, inc, thr, 4, h4 FROM el WHERE eligible AND h4 IS NOT NULL AND coalesce(h1, 0) = 0 AND coalesce(h2, 0) = 0 AND coalesce(h3, 0) = 0)
"""
EXACT = "(PARTITION BY entity ORDER BY datediff('day', DATE '1970-01-01', week_start) RANGE BETWEEN {a} PRECEDING AND {b} PRECEDING)"

QUERIES = [
    query("lag_features", lambda s, d: pick(X.lag_features(hp(s, d)), *[f"cases_lag{k}" for k in (1, 2, 4, 8)], *[f"{c}_lag{k}" for c in ("a_sum", "b_mean", "c_mean") for k in (1, 4)]), f"SELECT entity, week_start, {', '.join(f'lag(cases,{k}) OVER w cases_lag{k}' for k in (1, 2, 4, 8))}, {', '.join(f'lag({c},{k}) OVER w {c}_lag{k}' for c in ('a_sum', 'b_mean', 'c_mean') for k in (1, 4))} FROM hp {WINDOW}", " ".join(f"{c}_lag{k}" for c in ("a_sum", "b_mean", "c_mean") for k in (1, 4))),
    query("rolling_features", lambda s, d: pick(X.rolling_features(hp(s, d)), "cases_roll4_mean", "cases_roll8_mean", "a_sum_roll4_sum", "a_sum_roll8_sum", "b_mean_roll4_mean", "c_mean_roll4_mean"), f"SELECT entity, week_start, {roll('cases', 4)} cases_roll4_mean, {roll('cases', 8)} cases_roll8_mean, {roll('a_sum', 4, 'sum')} a_sum_roll4_sum, {roll('a_sum', 8, 'sum')} a_sum_roll8_sum, {roll('b_mean', 4)} b_mean_roll4_mean, {roll('c_mean', 4)} c_mean_roll4_mean FROM hp", "cases_roll4_mean cases_roll8_mean a_sum_roll4_sum a_sum_roll8_sum b_mean_roll4_mean c_mean_roll4_mean"),
    query("growth_ratios", lambda s, d: pick(X.growth_ratios(hp(s, d)), "growth1", "growth4"), f"SELECT entity, week_start, {', '.join(f'CASE WHEN lag(cases,{k}) OVER w IS NOT NULL THEN cases / greatest(lag(cases,{k}) OVER w, 1) END growth{k}' for k in (1, 4))} FROM hp {WINDOW}", "growth1 growth4"),
    query("incidence_roll", lambda s, d: pick(X.incidence_roll(hp(s, d)), "inc_roll4"), f"SELECT entity, week_start, {roll('cases', 4)} / greatest(population, 1) * 1e5 inc_roll4 FROM hp", "inc_roll4"),
    query("seasonality", lambda s, d: pick(X.seasonality(hp(s, d)), "iso_week", "week_sin", "week_cos"), "SELECT entity, week_start, weekofyear(week_start) iso_week, sin(2 * pi() * weekofyear(week_start) / 52) week_sin, cos(2 * pi() * weekofyear(week_start) / 52) week_cos FROM hp", "week_sin week_cos", "iso_week"),
    query("date_exact_lag", lambda s, d: pick(X.date_exact_lag(hp(s, d), "cases", (1, 2, 4)), "cases_exact1", "cases_exact2", "cases_exact4"), f"SELECT entity, week_start, {', '.join(f'first(cases) OVER {EXACT.format(a=7 * k, b=7 * k)} cases_exact{k}' for k in (1, 2, 4))} FROM hp"),
    query("date_exact_rolling", lambda s, d: pick(X.date_exact_rolling(hp(s, d), "a_sum", 4), "a_sum_exact_mean4", "a_sum_exact_sum4"), f"SELECT entity, week_start, CASE WHEN count(a_sum) OVER r = 4 THEN avg(a_sum) OVER r END a_sum_exact_mean4, CASE WHEN count(a_sum) OVER r = 4 THEN sum(a_sum) OVER r END a_sum_exact_sum4 FROM hp WINDOW r AS {EXACT.format(a=28, b=7)}", "a_sum_exact_mean4 a_sum_exact_sum4"),
    query("weeks_since_event", lambda s, d: pick(X.weeks_since_event(hp(s, d)), "weeks_since_hot"), f"SELECT entity, week_start, {SINCE.format(start=99, cap=200)} weeks_since_hot FROM (SELECT *, max(CASE WHEN prev = 1 THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING) mx FROM (SELECT *, coalesce(lag(hot) OVER w, 0) prev, row_number() OVER w rn FROM hp {WINDOW}))", longs="weeks_since_hot"),
    query("expanding_history", lambda s, d: pick(X.expanding_history(hp(s, d)), "hist_hot_rate", "hist_rate", "rate_vs_hist", "rate_lag26", "rate_lag52"), f"SELECT entity, week_start, avg(hot) OVER {PAST} hist_hot_rate, avg(inc) OVER {PAST} hist_rate, CASE WHEN avg(inc) OVER {PAST} IS NOT NULL THEN inc / greatest(avg(inc) OVER {PAST}, 0.01::DOUBLE) END rate_vs_hist, lag(inc,26) OVER ({W}) rate_lag26, lag(inc,52) OVER ({W}) rate_lag52 FROM hp", "hist_hot_rate hist_rate rate_vs_hist rate_lag26 rate_lag52"),
    query("week_of_year_anomaly", lambda s, d: pick(X.week_of_year_anomaly(hp(s, d), ["a_sum", "b_mean"]), "a_sum_anom", "b_mean_anom"), "SELECT entity, week_start, a_sum_anom, b_mean_anom FROM anom", "a_sum_anom b_mean_anom", ctes=ANOM),
    query("range_and_roll", lambda s, d: pick(X.range_and_roll(hp(s, d), "b_max", "b_min"), "value_range", "range_roll4"), f"SELECT entity, week_start, value_range, {roll('value_range', 4)} range_roll4 FROM (SELECT *, b_max - b_min value_range FROM hp)", "value_range range_roll4"),
    query("long_memory", lambda s, d: pick(X.long_memory(hp(s, d), "a_sum"), *[f"a_sum_lag{k}" for k in (8, 12, 16)], "a_sum_sum12", "a_sum_sum16"), f"SELECT entity, week_start, {', '.join(f'lag(a_sum,{k}) OVER ({W}) a_sum_lag{k}' for k in (8, 12, 16))}, {roll('a_sum', 12, 'sum')} a_sum_sum12, {roll('a_sum', 16, 'sum')} a_sum_sum16 FROM hp", "a_sum_lag8 a_sum_lag12 a_sum_lag16 a_sum_sum12 a_sum_sum16"),
    query("expanding_quantile", lambda s, d: pick(X.expanding_quantile(hp(s, d), "b_mean"), "b_mean_past_q"), f"SELECT entity, week_start, quantile_cont(b_mean, 0.25) OVER {PAST} b_mean_past_q FROM hp", "b_mean_past_q"),
    query("dry_spell_run", dry_spell, f"SELECT entity, week_start, dry_run, coalesce(lag(dry_run) OVER ({W}), 0) * greatest(coalesce(a_sum_anom, 0), 0) dry_then_wet FROM dry", "dry_then_wet", "dry_run", DRY),
    query("degree_accumulation", lambda s, d: pick(X.degree_accumulation(hp(s, d), "a_mean", 18.0), "degree_sum"), f"SELECT entity, week_start, {roll('e', 8, 'sum')} degree_sum FROM (SELECT *, greatest(a_mean - 18, 0) e FROM hp)", "degree_sum"),
    query("susceptible_pool", lambda s, d: pick(X.susceptible_pool(hp(s, d)), "susceptible", "susceptible_z"), f"SELECT entity, week_start, susceptible, CASE WHEN count(susceptible) OVER p >= 2 AND stddev_samp(susceptible) OVER p > 1e-9 THEN (susceptible - avg(susceptible) OVER p) / stddev_samp(susceptible) OVER p END susceptible_z FROM pool WINDOW p AS {PAST}", "susceptible susceptible_z", ctes=POOL),
    query("gain_since_event", lambda s, d: pick(X.gain_since_event(X.susceptible_pool(hp(s, d)), "susceptible"), "susceptible_gain"), f"SELECT entity, week_start, susceptible - last_value(CASE WHEN hot = 1 THEN susceptible END IGNORE NULLS) OVER {PAST} susceptible_gain FROM pool", "susceptible_gain", ctes=POOL),
    query("national_phase", lambda s, d: X.national_phase(hp(s, d)), f"SELECT week_start, nat_inc, nat_share_hot, nat_z, {SINCE.format(start=260, cap=260)} weeks_since_surge FROM (SELECT *, max(CASE WHEN surge THEN rn END) OVER (ORDER BY week_start ROWS UNBOUNDED PRECEDING) mx FROM n2)", "nat_inc nat_share_hot nat_z", "weeks_since_surge", """, n1 AS (SELECT week_start, sum(cases) / greatest(sum(population), 1) * 1e5 nat_inc, avg(hot) nat_share_hot FROM hp GROUP BY 1),
n2 AS (SELECT *, row_number() OVER (ORDER BY week_start) rn, CASE WHEN count(nat_inc) OVER p >= 2 AND stddev_samp(nat_inc) OVER p > 1e-9 THEN (nat_inc - avg(nat_inc) OVER p) / stddev_samp(nat_inc) OVER p END nat_z,
  coalesce(nat_inc >= quantile_cont(nat_inc, 0.75) OVER p, false) surge FROM n1 WINDOW p AS (ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""),
    query("published_index_lags", lambda s, d: pick(X.published_index_lags(hp(s, d), index_rows(s, d).withColumn("loaded", F.lit(1))), *[f"index_lag{k}" for k in (0, 2, 3, 6, 9, 12)], "index_trend"), "SELECT entity, week_start, " + ", ".join(f"i{k}.anom index_lag{k}" for k in (0, 2, 3, 6, 9, 12)) + ", i0.anom - i3.anom index_trend FROM hp " + " ".join(f'LEFT JOIN mi i{k} ON i{k}.m = year(week_start) * 12 + month(week_start) - 1 - {k}' for k in (0, 2, 3, 6, 9, 12)), " ".join(f"index_lag{k}" for k in (0, 2, 3, 6, 9, 12)) + " index_trend", ctes=INDEX + ', mi AS (SELECT "year" * 12 + "month" m, anom FROM idx)'),
    query("haversine_pairs", pairs, "SELECT entity, other, km, weight FROM pairs", "km weight", ctes=PAIRS),
    query("importation_force", lambda s, d: pick(X.importation_force(hp(s, d), pairs(s, d)), "import_force", "import_lag2", "import_roll4"), f"SELECT entity, week_start, import_force, lag(import_force,2) OVER ({W}) import_lag2, {roll('import_force', 4)} import_roll4 FROM forced", "import_force import_lag2 import_roll4", ctes=FORCE),
    query("hub_force", lambda s, d: pick(X.hub_force(hp(s, d), pairs(s, d), (1, 2, 3)), "hub_force"), "SELECT entity, week_start, coalesce(f, 0) hub_force FROM hp LEFT JOIN (SELECT p.entity, h.week_start, sum(weight * inc) / 1e6 f FROM hp h JOIN pairs p ON p.other = h.entity WHERE h.entity IN (1, 2, 3) GROUP BY 1, 2) USING (entity, week_start)", "hub_force", ctes=PAIRS),
    query("pivot_panel", lambda s, d: X.melt_panel(X.pivot_panel(hp(s, d), range(25), "cases"), range(25), "cases"), "SELECT entity, week_start, cases FROM hp"),
    query("contiguous_blocks", lambda s, d: pick(X.contiguous_blocks(hp(s, d)), "block"), f"SELECT entity, week_start, sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING) block FROM (SELECT *, CASE WHEN datediff('day', lag(week_start) OVER ({W}), week_start) = 7 THEN 0 ELSE 1 END n FROM hp)", longs="block"),
    query("sequence_windows", lambda s, d: pick(X.sequence_windows(hp(s, d), ["cases", "a_sum"]), F.array_join(F.transform("sequence", lambda x: x["cases"].cast("string")), ",").alias("cases_seq"), F.expr("aggregate(sequence, 0D, (t, x) -> t + x.a_sum)").alias("a_total")), f"SELECT entity, week_start, string_agg(cases::VARCHAR, ',') OVER b cases_seq, sum(a_sum) OVER b a_total FROM (SELECT *, sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING) block FROM (SELECT *, CASE WHEN datediff('day', lag(week_start) OVER ({W}), week_start) = 7 THEN 0 ELSE 1 END n FROM hp)) WINDOW b AS (PARTITION BY entity, block ORDER BY week_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER b = 12", "a_total"),
    query("clinical_ratios", lambda s, d: X.clinical_ratios(patients(s, d)).select("l_orderkey", "l_linenumber", *RATIOS), f"SELECT l_orderkey, l_linenumber, {', '.join(f'{v} {k}' for k, v in RATIOS.items())} FROM pat", " ".join(RATIOS), "l_linenumber", PATIENTS),
    query("seasonal_climatology", lambda s, d: pick(X.seasonal_climatology(hp(s, d).where("yr <= 1998"), hp(s, d).where("yr > 1998"), "hot"), "climatology"), "SELECT entity, week_start, coalesce(m, (SELECT avg(hot) FROM hp WHERE yr <= 1998)) climatology FROM (SELECT *, weekofyear(week_start) k FROM hp WHERE yr > 1998) LEFT JOIN (SELECT entity, weekofyear(week_start) k, avg(hot) m FROM hp WHERE yr <= 1998 GROUP BY 1, 2) USING (entity, k)", "climatology"),
    query("naive_baselines", lambda s, d: pick(labelled(s, d), "p1", "p2", "p3", "persistence_flag"), "SELECT entity, week_start, p1, p2, p3, hot persistence_flag FROM lab", "p1 p2 p3", "persistence_flag", LAB),
    query("feature_matrix", lambda s, d: pick(X.feature_matrix(hp(s, d)), "cases_lag1", "cases_roll4_mean", "growth1", "inc_roll4", "week_sin", "weeks_since_hot", "hist_rate", "susceptible", "susceptible_gain"), f"SELECT entity, week_start, lag(cases) OVER ({W}) cases_lag1, {roll('cases', 4)} cases_roll4_mean, CASE WHEN lag(cases) OVER ({W}) IS NOT NULL THEN cases / greatest(lag(cases) OVER ({W}), 1) END growth1, {roll('cases', 4)} / greatest(population, 1) * 1e5 inc_roll4, sin(2 * pi() * weekofyear(week_start) / 52) week_sin, {SINCE.format(start=99, cap=200)} weeks_since_hot, avg(inc) OVER {PAST} hist_rate, susceptible, susceptible - last_value(CASE WHEN hot = 1 THEN susceptible END IGNORE NULLS) OVER {PAST} susceptible_gain FROM (SELECT *, max(CASE WHEN prev = 1 THEN rn END) OVER ({W} ROWS UNBOUNDED PRECEDING) mx FROM (SELECT *, coalesce(lag(hot) OVER w, 0) prev, row_number() OVER w rn FROM pool {WINDOW}))", "cases_roll4_mean growth1 inc_roll4 week_sin hist_rate susceptible susceptible_gain", "weeks_since_hot", POOL),
    # labels
    query("continuation_label", lambda s, d: pick(L.continuation_label(hp(s, d), 2), "y"), f"SELECT entity, week_start, (coalesce(f >= thr, false))::INT y FROM (SELECT *, lead(inc,2) OVER w f, datediff('day', week_start, lead(week_start,2) OVER w) g FROM hp {WINDOW}) WHERE g = 14", longs="y"),
    query("eligible_mask", lambda s, d: pick(L.eligible_mask(hp(s, d)), "eligible"), "SELECT entity, week_start, eligible FROM lab", ctes=LAB),
    query("emergence_label", lambda s, d: pick(L.emergence_label(hp(s, d)), "y"), "SELECT entity, week_start, y FROM scored", longs="y", ctes=LAB),
    query("emergence_label_all", lambda s, d: pick(L.emergence_label(hp(s, d), keep_ineligible=True), "eligible", "y"), "SELECT entity, week_start, eligible, y FROM lab", longs="y", ctes=LAB),
    query("weeks_to_crossing", lambda s, d: pick(labelled(s, d), "weeks_to_crossing"), "SELECT entity, week_start, CASE WHEN y = 1 THEN ahead END weeks_to_crossing FROM lab", longs="weeks_to_crossing", ctes=LAB),
    query("peak_incidence_target", lambda s, d: pick(L.peak_incidence_target(hp(s, d)), "log_peak"), f"SELECT entity, week_start, ln(1 + max(inc) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) log_peak FROM hp", "log_peak"),
    query("lead_times", lead_summary, "SELECT count(*) n_caught, avg(k) mean_lead, quantile_cont(k, 0.5) median_lead, (SELECT string_agg(k || ':' || n, ';' ORDER BY k) FROM (SELECT k, count(*) n FROM c GROUP BY 1)) distribution FROM c", "mean_lead median_lead", "n_caught", LAB + ", c AS (SELECT weeks_to_crossing k FROM scored WHERE p3 >= thr / 2 AND y = 1 AND weeks_to_crossing IS NOT NULL)"),
    query("hazard_frame", hazards, "SELECT entity, week_start, k, hazard_y FROM hz", longs="k hazard_y", ctes=HAZARD),
    query("hazard_combine", combined_hazards, "SELECT entity, week_start, 1 - product(1 - least(inc / thr, 1.0::DOUBLE) / (k + 1)) risk FROM hz GROUP BY 1, 2", "risk", ctes=HAZARD),
    query("transition_label_other_panel", transitions, "SELECT setting, entity, week_start, y FROM tl WHERE eligible AND y IS NOT NULL", longs="y", ctes=TRANS),
]
