"""Forward-looking labels, eligibility and lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.spec import DEFAULT, PanelSpec, at_least


def continuation_label(df: DataFrame, horizon: int, threshold: str = "thr", spec: PanelSpec = DEFAULT) -> DataFrame:
    """y: is the row ``horizon`` weeks ahead at or above the threshold; rows without a row at that very date go."""
    ahead = F.datediff(F.lead(spec.week, horizon).over(spec.w), F.col(spec.week)) == 7 * horizon
    y = F.when(ahead, at_least(F.lead(spec.rate, horizon).over(spec.w), F.col(threshold)).cast("int"))
    return df.withColumn("y", y).where("y is not null")


def eligible_mask(df: DataFrame, quiet: int = 2, spec: PanelSpec = DEFAULT) -> DataFrame:
    """``eligible``: below the threshold now and on the ``quiet`` rows before, all of which exist; needs ``hot``."""
    calm = F.col("hot") == 0
    for k in range(1, quiet + 1):
        calm = calm & F.coalesce(F.lag("hot", k).over(spec.w) == 0, F.lit(False))
    return df.withColumn("eligible", calm)


def emergence_label(df: DataFrame, horizon: int = 4, quiet: int = 2, keep_ineligible: bool = False, spec: PanelSpec = DEFAULT) -> DataFrame:
    """y: does a quiet place cross within ``horizon`` weeks; null without all weeks ahead; needs ``hot``."""
    frame = spec.w.rowsBetween(1, horizon)
    there = (F.count("hot").over(frame) == horizon) & (F.datediff(F.lead(spec.week, horizon).over(spec.w), F.col(spec.week)) == 7 * horizon)
    marked = eligible_mask(df, quiet, spec).withColumn("y", F.when(there, F.max("hot").over(frame)))
    return marked if keep_ineligible else marked.where("eligible and y is not null")


def weeks_to_crossing(df: DataFrame, horizon: int = 4, spec: PanelSpec = DEFAULT) -> DataFrame:
    """First week ahead that is hot, where y is 1; needs ``hot`` and ``y`` on all rows of an entity."""
    first = F.coalesce(*(F.when(F.lead("hot", k).over(spec.w) == 1, k) for k in range(1, horizon + 1)))
    return df.withColumn("weeks_to_crossing", F.when(F.col("y") == 1, first))


def peak_incidence_target(df: DataFrame, horizon: int = 4, spec: PanelSpec = DEFAULT) -> DataFrame:
    """log(1 + highest rate in the weeks ahead), from as many as there are."""
    return df.withColumn("log_peak", F.log1p(F.max(spec.rate).over(spec.w.rowsBetween(1, horizon))))


def lead_times(df: DataFrame, flagged: str) -> DataFrame:
    """Lead of caught crossings: count, mean, median and the counts by week as one string."""
    caught = df.where(F.col(flagged) & (F.col("y") == 1) & F.col("weeks_to_crossing").isNotNull())
    stats = caught.agg(F.count("*").alias("n_caught"), F.avg("weeks_to_crossing").alias("mean_lead"), F.percentile("weeks_to_crossing", F.lit(0.5)).alias("median_lead"))
    by = caught.groupBy("weeks_to_crossing").count().agg(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(":", F.col("weeks_to_crossing").cast("string"), F.col("count").cast("string"))))).alias("distribution"))
    return stats.crossJoin(F.broadcast(by))


def hazard_frame(df: DataFrame, horizon: int = 4, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row for each (row, week ahead k) still at risk: not crossed before k, and week k observed; y = hot at k."""
    leads = df.withColumn("_ahead", F.array(*(F.lead("hot", k).over(spec.w) for k in range(1, horizon + 1)))).where("eligible")
    rows = leads.select("*", F.posexplode("_ahead").alias("_k", "hazard_y"))
    at_risk = F.col("hazard_y").isNotNull() & ~F.exists(F.slice("_ahead", F.lit(1), F.col("_k")), lambda x: F.coalesce(x == 1, F.lit(False)))
    return rows.where(at_risk).withColumn("k", F.col("_k") + 1).drop("_ahead", "_k")


def hazard_combine(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """1 - product over the weeks of (1 - p), p clipped to 0..1."""
    return df.groupBy(*keys).agg((1 - F.product(1 - F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)))).alias("risk"))


def transition_labels(df: DataFrame, settings: DataFrame, quiet: int = 2, most_horizon: int = 4, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Eligibility and emergence label for several (horizon, threshold) settings, a few rows, at once."""
    rows = df.join(F.broadcast(settings)).withColumn("hot", at_least(F.col(spec.rate), F.col("threshold")).cast("int"))
    w = Window.partitionBy("setting", spec.entity).orderBy(spec.week)
    calm = F.col("hot") == 0
    for k in range(1, quiet + 1):
        calm = calm & F.coalesce(F.lag("hot", k).over(w) == 0, F.lit(False))
    y = F.lit(None).cast("int")
    for h in range(1, most_horizon + 1):
        frame = w.rowsBetween(1, h)
        there = (F.count("hot").over(frame) == h) & (F.datediff(F.lead(spec.week, h).over(w), F.col(spec.week)) == 7 * h)
        y = F.when(F.col("horizon") == h, F.when(there, F.max("hot").over(frame))).otherwise(y)
    return rows.withColumns({"eligible": calm, "y": y}).where("eligible and y is not null")
