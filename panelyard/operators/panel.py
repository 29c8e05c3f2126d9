"""Panel construction: weekly counts, exposure roll-up, joins, source reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.spec import DEFAULT, PanelSpec


def snap_to_week(df: DataFrame, day: str, name: str = "week_start") -> DataFrame:
    """The Monday on or before a date."""
    return df.withColumn(name, F.date_trunc("week", F.col(day)).cast("date"))


def weekly_counts(events: DataFrame, entity: str, day: str, counted: Column) -> DataFrame:
    """Sum of ``counted`` for each entity and week."""
    return snap_to_week(events, day).groupBy(F.col(entity).alias("entity"), "week_start").agg(F.sum(counted).alias("cases"))


def weekly_exposure_rollup(daily: DataFrame, more: dict[str, Column] | None = None, wet: float = 25.0) -> DataFrame:
    """Week aggregates of daily exposure; ``a_days`` counts the days at or above ``wet``. ``more``: further aggregates by name."""
    a, b, c = F.col("exposure_a"), F.col("exposure_b"), F.col("exposure_c")
    return snap_to_week(daily, "day").groupBy("entity", "week_start").agg(
        F.sum(a).alias("a_sum"), F.avg(a).alias("a_mean"), F.max(a).alias("a_max"), F.count_if(a >= wet).alias("a_days"),
        F.avg(b).alias("b_mean"), F.max(b).alias("b_max"), F.min(b).alias("b_min"), F.avg(c).alias("c_mean"), *(a.alias(k) for k, a in (more or {}).items()),
    )


def panel_join(cases: DataFrame, exposure: DataFrame, meta: DataFrame) -> DataFrame:
    """Inner join on entity and week, then the entity's own columns."""
    return cases.join(exposure, ["entity", "week_start"]).join(meta, "entity", "left")


def panel_rates(panel: DataFrame) -> DataFrame:
    """Density, incidence per 100,000 and year; null where the denominator is 0."""
    return panel.withColumns({
        "density": F.col("population") / F.nullif(F.col("area"), F.lit(0)),
        "incidence": F.col("cases") / F.nullif(F.col("population"), F.lit(0)) * 1e5,
        "year": F.year("week_start"),
    })


def merge_source_priority(sources: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """One row per entity and week, the first source that has it; rows without a week go."""
    stacked = None
    for k, (df, name) in enumerate(zip(sources, names, strict=True)):
        part = df.select("entity", "week_start", "cases").withColumns({"priority": F.lit(k), "source": F.lit(name)})
        stacked = part if stacked is None else stacked.unionByName(part)
    first = Window.partitionBy("entity", "week_start").orderBy("priority")
    kept = stacked.where("week_start is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select(
        "entity", "week_start", "cases", "source", F.extract(F.lit("YEAROFWEEK"), "week_start").alias("iso_year"), F.weekofyear("week_start").alias("iso_week"),
        F.date_format("week_start", "MM/dd/yyyy").alias("start_date"), F.date_format(F.date_add("week_start", 6), "MM/dd/yyyy").alias("end_date"),
    )


def upsert_keep_last(old: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append and keep the row loaded last for each key: one hash aggregate, no sort."""
    both = old.withColumn("_load", F.lit(0)).unionByName(fresh.withColumn("_load", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_load").alias("_last"))
    return last.select(*keys, "_last.*")


def newer_than_watermark(df: DataFrame, other: DataFrame, week: str = "week_start") -> DataFrame:
    """Rows later than the last week of another source."""
    mark = other.agg(F.max(week).alias("_mark"))
    return df.join(F.broadcast(mark), F.col(week) > F.col("_mark")).drop("_mark")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both counts for the keys that both sources have, with absolute and relative difference."""
    both = left.select("entity", "week_start", F.col("cases").alias("cases_a")).join(right.select("entity", "week_start", F.col("cases").alias("cases_b")), ["entity", "week_start"])
    gap = F.abs(F.col("cases_a") - F.col("cases_b"))
    return both.withColumns({"abs_diff": gap, "rel_diff": gap / F.greatest("cases_b", F.lit(1))})


def reconcile_sources(left: DataFrame, right: DataFrame, tolerance: float = 0.05, floor: float = 0.95) -> DataFrame:
    """One row: how well two sources agree where they overlap."""
    stats = differences(left, right).agg(
        F.count("*").alias("n"), F.avg((F.col("abs_diff") == 0).cast("double")).alias("exact_rate"),
        F.avg((F.col("rel_diff") <= tolerance).cast("double")).alias("within_rate"), F.max("abs_diff").alias("max_diff"),
    )
    return stats.withColumn("verdict", F.when(F.col("n") == 0, "NO OVERLAP").when(F.col("within_rate") >= floor, "PASS").otherwise("FAIL"))


def reconcile_worst(left: DataFrame, right: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest absolute differences, ties by key."""
    return differences(left, right).orderBy(F.desc("abs_diff"), "entity", "week_start").limit(n)


def totals_self_check(rows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Sum of the parsed rows against the total that the report states, nulls grouped too."""
    by = rows.groupBy("week_start", "stated_total").agg(F.sum("cases").alias("parsed_total"))
    rel = F.abs(F.col("parsed_total") - F.col("stated_total")) / F.greatest("stated_total", F.lit(1))
    return by.withColumn("rel_diff", F.when(F.col("stated_total").isNotNull(), rel)).withColumn("ok", F.when(F.col("rel_diff").isNotNull(), F.col("rel_diff") <= tolerance))


def totals_verdict(checks: DataFrame) -> DataFrame:
    """EMPTY, PASS, PARTIAL or FAIL over the checks that could be made."""
    counted = checks.agg(F.count("ok").alias("n_checked"), F.count_if("ok").alias("n_ok"))
    verdict = F.when(F.col("n_checked") == 0, "EMPTY").when(F.col("n_ok") == F.col("n_checked"), "PASS").when(F.col("n_ok") > 0, "PARTIAL").otherwise("FAIL")
    return counted.withColumns({"pass_rate": F.col("n_ok") / F.nullif(F.col("n_checked"), F.lit(0)), "verdict": verdict})


def situation_table(panel: DataFrame, people: DataFrame) -> DataFrame:
    """The latest week: change on the week before and incidence, unknown places with population 0."""
    w = Window.partitionBy("entity").orderBy("week_start")
    rows = panel.select("entity", "week_start", "cases", F.lag("cases").over(w).alias("prev_week"))
    last = panel.agg(F.max("week_start").alias("_last"))
    latest = rows.join(F.broadcast(last), F.col("week_start") == F.col("_last")).drop("_last").join(people.select("entity", "population"), "entity", "left")
    change = F.col("cases") - F.col("prev_week")
    return latest.select(
        "entity", "week_start", "cases", "prev_week", change.alias("change"), (change / F.greatest("prev_week", F.lit(1)) * 100).alias("change_pct"),
        F.coalesce("population", F.lit(0)).alias("population"), (F.col("cases") / F.greatest(F.coalesce("population", F.lit(0)), F.lit(1)) * 1e5).alias("inc100k"),
    )


def situation_history(panel: DataFrame, weeks: int) -> DataFrame:
    """Entity, week and count of the trailing weeks."""
    last = panel.agg(F.max("week_start").alias("_last"))
    return panel.join(F.broadcast(last), F.col("week_start") > F.date_sub(F.col("_last"), 7 * weeks)).select("entity", "week_start", "cases")


def freshness_stats(sources: dict[str, DataFrame], as_of: Column, stale_days: int = 28) -> DataFrame:
    """Latest week, age and row count of each source."""
    stacked = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), "week_start")
        stacked = part if stacked is None else stacked.unionByName(part)
    by = stacked.groupBy("source").agg(F.max("week_start").alias("latest_week"), F.count("*").alias("n_rows"))
    age = F.datediff(as_of, F.col("latest_week"))
    return by.withColumns({"overall_latest": F.max("latest_week").over(Window.partitionBy()), "age_days": age, "stale": age > stale_days})


def dedup_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def panel_integrity(panel: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows, steps of 7 and 14 days, other steps, duplicate keys and weekdays seen."""
    step = F.datediff(F.col(spec.week), F.lag(spec.week).over(spec.w))
    stepped = panel.select(spec.entity, spec.week, step.alias("step"))
    return stepped.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("step") == 7).alias("clean_steps"), F.count_if(F.col("step") == 14).alias("gaps_14"),
        F.count_if((F.col("step") != 7) & (F.col("step") != 0)).alias("other_steps"), F.count_if(F.col("step") == 0).alias("duplicate_keys"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.weekday(spec.week).cast("string")))).alias("weekdays"),
    )


def distinct_counts(df: DataFrame, label: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Exact distinct weeks and entities, positives and prevalence."""
    return df.agg(F.countDistinct(spec.week).alias("n_weeks"), F.countDistinct(spec.entity).alias("n_entities"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("prevalence"))


def union_folds(parts: dict[int, DataFrame]) -> DataFrame:
    """Stack frames by fold."""
    out = None
    for fold, df in parts.items():
        df = df.withColumn("fold", F.lit(fold))
        out = df if out is None else out.unionByName(df)
    return out


def schema_intersection(left: DataFrame, right: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that both frames have, sorted."""
    return sorted(set(wanted) & set(left.columns) & set(right.columns))
