"""Past-only features of an entity-by-week panel.

A value at week T does not change when later weeks are deleted. All features of one
entity share one partitioning and one order, so Spark plans one exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.blocks import weighted_sums
from panelyard.functions.streams import past_quantile
from panelyard.functions.windows import clip, full, past_z, ratio_to, rolling_mean, rolling_sum, rows_since, run_length
from panelyard.spec import DEFAULT, PanelSpec, at_least

KEYS = ("entity", "week_start")


def lag_features(df: DataFrame, spec: PanelSpec = DEFAULT, lags: Sequence[int] = (1, 2, 4, 8), exposure_lags: Sequence[int] = (1, 4)) -> DataFrame:
    """Values of earlier rows of the entity, by position."""
    own = {f"{spec.count}_lag{k}": F.lag(spec.count, k).over(spec.w) for k in lags}
    return df.withColumns(own | {f"{c}_lag{k}": F.lag(c, k).over(spec.w) for c in spec.exposures for k in exposure_lags})


def rolling_features(df: DataFrame, spec: PanelSpec = DEFAULT, sizes: Sequence[int] = (4, 8)) -> DataFrame:
    """Means and sums over the rows before the current one, full windows only."""
    own = {f"{spec.count}_roll{n}_mean": rolling_mean(F.col(spec.count), spec.w, n) for n in sizes}
    first, *rest = spec.exposures
    sums = {f"{first}_roll{n}_sum": rolling_sum(F.col(first), spec.w, n) for n in sizes}
    return df.withColumns(own | sums | {f"{c}_roll{n}_mean": rolling_mean(F.col(c), spec.w, n) for c in rest for n in sizes[:1]})


def growth_ratios(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Count over the count 1 and 4 rows ago, at least 1."""
    return df.withColumns({f"growth{k}": ratio_to(F.col(spec.count), F.lag(spec.count, k).over(spec.w), 1.0) for k in (1, 4)})


def incidence_roll(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean of the last four counts per 100,000 people."""
    return df.withColumn("inc_roll4", rolling_mean(F.col(spec.count), spec.w, 4) / F.greatest(spec.population, F.lit(1)) * 1e5)


def seasonality(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    angle = 2 * F.pi() * F.weekofyear(spec.week) / 52
    return df.withColumns({"iso_week": F.weekofyear(spec.week), "week_sin": F.sin(angle), "week_cos": F.cos(angle)})


def date_exact_lag(df: DataFrame, column: str, weeks: Sequence[int], spec: PanelSpec = DEFAULT) -> DataFrame:
    """The value exactly k calendar weeks earlier, null across gaps."""
    return df.withColumns({f"{column}_exact{k}": F.first(column).over(spec.by_day.rangeBetween(-7 * k, -7 * k)) for k in weeks})


def date_exact_rolling(df: DataFrame, column: str, n: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean and sum over the n calendar weeks before, if all are there."""
    frame = spec.by_day.rangeBetween(-7 * n, -7)
    value = F.col(column)
    return df.withColumns({f"{column}_exact_mean{n}": full(value, F.avg(value), frame, n), f"{column}_exact_sum{n}": full(value, F.sum(value), frame, n)})


def weeks_since_event(df: DataFrame, spec: PanelSpec = DEFAULT, start: int = 99, cap: int = 200) -> DataFrame:
    """Rows since the row before was hot; needs ``hot`` (0/1)."""
    return df.withColumn("prev_hot", F.coalesce(F.lag("hot").over(spec.w), F.lit(0))).withColumn("weeks_since_hot", rows_since(F.col("prev_hot") == 1, spec.w, start, cap)).drop("prev_hot")


def expanding_history(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of hot weeks and mean rate so far, rate against that mean, rate 26 and 52 rows ago; needs ``hot``."""
    past = spec.past()
    mean = F.avg(spec.rate).over(past)
    return df.withColumns({
        "hist_hot_rate": F.avg("hot").over(past), "hist_rate": mean, "rate_vs_hist": ratio_to(F.col(spec.rate), mean, 0.01),
        "rate_lag26": F.lag(spec.rate, 26).over(spec.w), "rate_lag52": F.lag(spec.rate, 52).over(spec.w),
    })


def week_of_year_anomaly(df: DataFrame, columns: Sequence[str], spec: PanelSpec = DEFAULT, least_years: int = 4, limit: float = 6.0) -> DataFrame:
    """Distance from the same ISO week of earlier years, in their standard deviations."""
    frame = Window.partitionBy(spec.entity, F.weekofyear(spec.week)).orderBy(spec.week).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{c}_anom": clip(past_z(F.col(c), frame, F.stddev_samp(c), 1e-6, least_years), -limit, limit) for c in columns})


def range_and_roll(df: DataFrame, high: str, low: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Range of a week and its mean over the four rows before."""
    return df.withColumn("value_range", F.col(high) - F.col(low)).withColumn("range_roll4", rolling_mean(F.col("value_range"), spec.w, 4))


def long_memory(df: DataFrame, column: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Lags 8, 12 and 16, and sums over the 12 and 16 rows before."""
    lags = {f"{column}_lag{k}": F.lag(column, k).over(spec.w) for k in (8, 12, 16)}
    return df.withColumns(lags | {f"{column}_sum{n}": rolling_sum(F.col(column), spec.w, n) for n in (12, 16)})


def expanding_quantile(df: DataFrame, column: str, share: float = 0.25, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Quantile of all earlier rows of the entity, by linear interpolation; every row costs the logarithm of its history."""
    return past_quantile(df, [spec.entity], [spec.week], column, share, f"{column}_past_q")


def dry_spell_run(df: DataFrame, column: str, wet: str, spec: PanelSpec = DEFAULT, cap: int = 52) -> DataFrame:
    """Consecutive rows below the entity's own past quartile, and the run before times the present wetness anomaly.

    ``wet``: an anomaly column; null counts as 0.
    """
    cut = expanding_quantile(df, column, 0.25, spec)
    dry = F.coalesce(F.col(column) < F.col(f"{column}_past_q"), F.lit(False))
    ran = cut.withColumn("dry_run", run_length(dry, spec.w, cap))
    return ran.withColumn("dry_then_wet", F.coalesce(F.lag("dry_run").over(spec.w), F.lit(0)) * F.greatest(F.coalesce(F.col(wet), F.lit(0.0)), F.lit(0.0)))


def degree_accumulation(df: DataFrame, column: str, base: float, weeks: int = 8, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Sum of the excess over a base in the rows before."""
    excess = F.when(F.col(column).isNotNull(), F.greatest(F.col(column) - base, F.lit(0.0)))
    return df.withColumn("excess", excess).withColumn("degree_sum", rolling_sum(F.col("excess"), spec.w, weeks))


def susceptible_pool(df: DataFrame, spec: PanelSpec = DEFAULT, multiplier: float = 4.0, half_life: float = 156.0) -> DataFrame:
    """1 - m for the capped accumulator m = min(1, m d + a), a the infected share of the row before, and its past z-score.

    Closed form: with S the uncapped sum, m = S - max(0, max over the past of (S - 1) d^(age)).
    """
    decay = 0.5 ** (1 / half_life)
    share = F.coalesce(F.lag(F.col(spec.count) * multiplier / F.greatest(spec.population, F.lit(1))).over(spec.w), F.lit(0.0))
    upto = spec.w.rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn("_i", F.row_number().over(spec.w).cast("double")).withColumn("_a", share)
    grown = grown.withColumn("_s", F.pow(F.lit(decay), "_i") * F.sum(F.col("_a") * F.pow(F.lit(decay), -F.col("_i"))).over(upto))
    over = F.pow(F.lit(decay), "_i") * F.max(F.pow(F.lit(decay), -F.col("_i")) * (F.col("_s") - 1)).over(upto)
    pool = grown.withColumn("susceptible", 1 - (F.col("_s") - F.greatest(over, F.lit(0.0))))
    return pool.withColumn("susceptible_z", past_z(F.col("susceptible"), spec.past(), F.stddev_samp("susceptible"), 1e-9, 2)).drop("_i", "_a", "_s")


def gain_since_event(df: DataFrame, column: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Value less its value at the last earlier hot row; null before any; needs ``hot``."""
    last = F.last(F.when(F.col("hot") == 1, F.col(column)), ignorenulls=True).over(spec.past())
    return df.withColumn(f"{column}_gain", F.col(column) - last)


def national_phase(df: DataFrame, spec: PanelSpec = DEFAULT, start: int = 260) -> DataFrame:
    """One row per week: overall incidence, share of hot entities, past z-score, weeks since the last surge; needs ``hot``.

    The overall series has one row a week, so its window runs in one task by nature.
    """
    by = df.groupBy(spec.week).agg((F.sum(spec.count) / F.greatest(F.sum(spec.population), F.lit(1)) * 1e5).alias("nat_inc"), F.avg("hot").alias("nat_share_hot"))
    w = Window.orderBy(spec.week)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    cut = past_quantile(by, [], [spec.week], "nat_inc", 0.75, "_cut")
    surged = cut.withColumns({
        "nat_z": past_z(F.col("nat_inc"), past, F.stddev_samp("nat_inc"), 1e-9, 2), "_surge": F.coalesce(F.col("nat_inc") >= F.col("_cut"), F.lit(False)),
    })
    return surged.withColumn("weeks_since_surge", rows_since(F.col("_surge"), w, start, start)).drop("_surge", "_cut")


def published_index_lags(df: DataFrame, index: DataFrame, lags: Sequence[int] = (0, 2, 3, 6, 9, 12), delay: int = 1, spec: PanelSpec = DEFAULT) -> DataFrame:
    """A monthly index as it was published: the value ``delay`` + lag months before the week's month, and lag 0 - lag 3.

    ``index``: (year, month, anom), at most one row for each month is used, the last loaded.
    """
    one = index.groupBy((F.col("year") * 12 + F.col("month")).alias("_m")).agg(F.max_by("anom", F.monotonically_increasing_id()).alias("anom")) if "loaded" not in index.columns else index.groupBy((F.col("year") * 12 + F.col("month")).alias("_m")).agg(F.max_by("anom", "loaded").alias("anom"))
    shifted = one.select(F.explode(F.array(*(F.struct((F.col("_m") + delay + k).alias("at"), F.lit(k).alias("lag")) for k in lags))).alias("s"), "anom").groupBy(F.col("s.at").alias("_at"))
    wide = shifted.pivot("s.lag", list(lags)).agg(F.first("anom"))
    wide = wide.select("_at", *(F.col(str(k)).alias(f"index_lag{k}") for k in lags))
    month = F.year(spec.week) * 12 + F.month(spec.week)
    joined = df.join(wide.hint("shuffle_hash"), month == F.col("_at"), "left").drop("_at")
    return joined.withColumn("index_trend", F.col("index_lag0") - F.col("index_lag3"))


#: Places of one block in ``haversine_pairs``.
PLACES = 256


def haversine_pairs(places: DataFrame, floor_km: float = 25.0, blocks: int | None = None) -> DataFrame:
    """(entity, other, km, weight = population of other / km^2) for ordered pairs of places, distances at least ``floor_km``.

    Pairs are the square of the places, by definition. Both sides are dealt into blocks of
    about ``PLACES`` and each pair of blocks meets in a group of its own, so no side is
    broadcast or held whole, and groups stay as large however many places there are.
    """
    blocks = blocks or max(1, -(-places.count() // PLACES))

    def block(key: str, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).alias(name)

    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    a = places.select("entity", F.radians("lat").alias("lat_a"), F.radians("lon").alias("lon_a"), block("entity", "_a"), F.explode(every).alias("_b"))
    b = places.select(F.col("entity").alias("other"), F.radians("lat").alias("lat_b"), F.radians("lon").alias("lon_b"), F.col("population").alias("pop_b"), block("entity", "_b"), F.explode(every).alias("_a"))
    pairs = a.join(b.hint("merge"), ["_a", "_b"]).where("entity <> other")
    h = F.pow(F.sin((F.col("lat_b") - F.col("lat_a")) / 2), 2) + F.cos("lat_a") * F.cos("lat_b") * F.pow(F.sin((F.col("lon_b") - F.col("lon_a")) / 2), 2)
    km = F.greatest(2 * 6371.0 * F.asin(F.sqrt(h)), F.lit(floor_km))
    return pairs.select("entity", "other", km.alias("km"), (F.col("pop_b") / (km * km)).alias("weight"))


def force(df: DataFrame, pairs: DataFrame, name: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Weighted rate of other places in the same week, over rows of ``df``: (entity, week, force); 0 where nothing pushes."""
    rates = df.select(F.col(spec.entity).alias("other"), F.col(spec.week).alias("at"), F.col(spec.rate).alias("value"))
    pushed = weighted_sums(pairs.select(F.col("entity").alias("row"), "other", "weight"), rates)
    return pushed.select(F.col("row").alias(spec.entity), F.col("at").alias(spec.week), (F.col("total") / 1e6).alias(name))


def importation_force(df: DataFrame, pairs: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Pressure from hot places, its value two rows ago and its mean over the four rows before; needs ``hot``.

    Entities that have no pair get null; a week without hot places elsewhere has 0.
    """
    pushed = force(df.where("hot = 1"), pairs, "import_force", spec)
    known = pairs.select(F.col("entity").alias(spec.entity)).distinct().withColumn("_known", F.lit(True))
    joined = df.join(pushed.hint("merge"), [spec.entity, spec.week], "left").join(known.hint("merge"), spec.entity, "left")
    filled = joined.withColumn("import_force", F.when(F.col("_known"), F.coalesce("import_force", F.lit(0.0)))).drop("_known")
    return filled.withColumns({"import_lag2": F.lag("import_force", 2).over(spec.w), "import_roll4": rolling_mean(F.col("import_force"), spec.w, 4)})


def hub_force(df: DataFrame, pairs: DataFrame, hubs: Sequence[int], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Pressure from hub places, hot or not."""
    pushed = force(df.where(F.col(spec.entity).isin(list(hubs))), pairs, "hub_force", spec)
    return df.join(pushed.hint("merge"), [spec.entity, spec.week], "left").withColumn("hub_force", F.coalesce("hub_force", F.lit(0.0)))


def pivot_panel(df: DataFrame, entities: Sequence[int], column: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Week by entity, one column for each of the stated entities."""
    wide = df.groupBy(spec.week).pivot(spec.entity, list(entities)).agg(F.first(column))
    return wide.select(spec.week, *(F.col(f"`{e}`").alias(f"e{e}") for e in entities))


def melt_panel(wide: DataFrame, entities: Sequence[int], column: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The long form of a pivoted panel, cells without value left out."""
    long = wide.unpivot([spec.week], [f"e{e}" for e in entities], "_name", column)
    return long.where(F.col(column).isNotNull()).select(F.substring("_name", 2, 20).cast("long").alias(spec.entity), spec.week, column)


def contiguous_blocks(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``block``: a new number after every step that is not seven days."""
    gap = F.datediff(F.col(spec.week), F.lag(spec.week).over(spec.w))
    return df.withColumn("_new", F.when(gap == 7, 0).otherwise(1)).withColumn("block", F.sum("_new").over(spec.w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sequence_windows(df: DataFrame, columns: Sequence[str], length: int = 12, spec: PanelSpec = DEFAULT) -> DataFrame:
    """The last ``length`` rows as an array of structs, never across a gap; rows with fewer are left out."""
    frame = Window.partitionBy(spec.entity, "block").orderBy(spec.week).rowsBetween(1 - length, 0)
    blocked = contiguous_blocks(df, spec)
    return blocked.withColumn("sequence", F.collect_list(F.struct(*columns)).over(frame)).where(F.size("sequence") == length)


def clinical_ratios(df: DataFrame) -> DataFrame:
    """Blood-count ratios, each where its inputs are columns: plt, wbc, neu, lym, mono, mpv, rdw, hct."""
    c, have = F.col, set(df.columns)

    def over(top, bottom, floor):
        return top / F.greatest(bottom, F.lit(floor))

    neut, lymph = c("wbc") * c("neu") / 100, c("wbc") * c("lym") / 100
    made = {
        ("plt", "wbc"): ("plt_wbc", lambda: over(c("plt"), c("wbc"), 1.0)), ("neu", "lym"): ("nlr", lambda: over(c("neu"), c("lym"), 1.0)),
        ("plt", "lym"): ("plr", lambda: over(c("plt"), c("lym"), 1.0)), ("mpv", "plt"): ("mpv_plt", lambda: over(c("mpv"), c("plt") / 1000, 1e-6)),
        ("wbc", "neu"): ("neut_abs", lambda: neut), ("wbc", "lym"): ("lymph_abs", lambda: lymph),
        ("wbc", "neu", "lym", "plt"): ("sii", lambda: over(neut * c("plt"), lymph, 1.0)), ("wbc", "mono"): ("mono_abs", lambda: c("wbc") * c("mono") / 100),
        ("lym", "mono"): ("lmr", lambda: over(c("lym"), c("mono"), 0.1)), ("plt", "mpv"): ("plateletcrit", lambda: c("plt") * c("mpv") / 1e4),
        ("rdw", "plt"): ("rdw_plt", lambda: over(c("rdw"), c("plt") / 1000, 1e-6)), ("hct", "plt"): ("hct_plt", lambda: over(c("hct"), c("plt") / 1000, 1e-6)),
    }
    return df.withColumns({name: make() for needs, (name, make) in made.items() if have.issuperset(needs)})


def seasonal_climatology(train: DataFrame, rows: DataFrame, label: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean training label of the entity and ISO week, else the overall training mean."""
    week = F.weekofyear(spec.week)
    mean = train.groupBy(F.col(spec.entity), week.alias("iso_week")).agg(F.avg(label).alias("_mean"))
    overall = train.agg(F.avg(label).alias("_all"))
    joined = rows.withColumn("iso_week", week).join(mean, [spec.entity, "iso_week"], "left").crossJoin(F.broadcast(overall))
    return joined.withColumn("climatology", F.coalesce("_mean", "_all")).drop("_mean", "_all", "iso_week")


def naive_baselines(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Persistence, growth product and moving average as scores; needs ``hot``."""
    grown = F.coalesce(ratio_to(F.col(spec.count), F.lag(spec.count).over(spec.w), 1.0), F.lit(1.0))
    mean = rolling_mean(F.col(spec.count), spec.w, 4) / F.greatest(spec.population, F.lit(1)) * 1e5
    return df.withColumns({"persistence": F.col(spec.rate), "persistence_flag": at_least(F.col("hot"), 1).cast("int"), "growth_product": F.col(spec.rate) * grown, "moving_average": F.coalesce(mean, F.lit(0.0))})


def feature_matrix(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """All feature blocks that need nothing but the panel, in one pass over one sort; needs ``hot``."""
    for block in (lag_features, rolling_features, growth_ratios, incidence_roll, seasonality, weeks_since_event, expanding_history, susceptible_pool):
        df = df.transform(block, spec)
    return df.transform(gain_since_event, "susceptible", spec)
