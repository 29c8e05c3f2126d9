"""Splits in time and space, sweeps and stress tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scans import running
from panelyard.operators.metrics import ranking_scores, roc_auc
from panelyard.spec import DEFAULT, PanelSpec, at_least


def hash_number(*parts: Column) -> Column:
    """A reproducible number below 2^32 from the first digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def temporal_split(df: DataFrame, train_end: int, val_end: int, year: str = "yr") -> DataFrame:
    return df.withColumn("split", F.when(F.col(year) <= train_end, "train").when(F.col(year) <= val_end, "val").otherwise("test"))


def rolling_origin(df: DataFrame, last_year: int, year: str = "yr") -> DataFrame:
    """Rows by (fold, role): a fold tests one year and trains on all earlier years; folds without training rows are left out."""
    years = df.select(F.col(year).alias("fold")).distinct().where(F.col("fold") <= last_year)
    first = df.agg(F.min(year).alias("_first"))
    folds = years.join(F.broadcast(first), F.col("fold") > F.col("_first")).drop("_first")
    # one row for each year
    return df.join(F.broadcast(folds), F.col(year) <= F.col("fold")).withColumn("role", F.when(F.col(year) == F.col("fold"), "test").otherwise("train"))


def spatial_holdout(df: DataFrame, entity: str = "entity", share: int = 4) -> DataFrame:
    """``unseen``: entities whose md5 begins with a digit below ``share``."""
    return df.withColumn("unseen", F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 1), 16, 10).cast("int") < share)


def leave_group_out(df: DataFrame, regions: DataFrame, y: str, p: str) -> DataFrame:
    """Metrics on each region as the one held out."""
    return scores_by(df.join(regions, "entity"), ["region"], y, p)


def scores_by(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """n, positives, prevalence, average precision and ROC AUC for each group."""
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("positives"), F.avg(y).alias("prevalence"))
    return base.join(ranking_scores(df, keys, y, p).hint("merge"), list(keys), "left")


def horizon_rows(df: DataFrame, horizons: Sequence[int], p: str = "inc", spec: PanelSpec = DEFAULT) -> DataFrame:
    """(horizon, p, y): a score beside the continuation label of several horizons."""
    labels = F.array(*(
        F.struct(F.lit(h).alias("horizon"), F.when(F.datediff(F.lead(spec.week, h).over(spec.w), F.col(spec.week)) == 7 * h, at_least(F.lead(spec.rate, h).over(spec.w), F.col("thr")).cast("int")).alias("y"))
        for h in horizons
    ))
    rows = df.select(F.col(p).alias("p"), labels.alias("labels")).select("p", F.explode("labels").alias("l")).select("p", "l.horizon", "l.y")
    return rows.where("y is not null")


def horizon_sweep(df: DataFrame, horizons: Sequence[int], p: str = "inc", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Metrics of a score for several horizons of the continuation label, in one job."""
    return scores_by(horizon_rows(df, horizons, p, spec), ["horizon"])


def threshold_sweep(df: DataFrame, thresholds: DataFrame, horizon: int, p: str = "inc", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Metrics for several thresholds, a few rows (threshold_name, cut)."""
    ahead = F.datediff(F.lead(spec.week, horizon).over(spec.w), F.col(spec.week)) == 7 * horizon
    rows = df.select(F.col(p).alias("p"), F.when(ahead, F.coalesce(F.lead(spec.rate, horizon).over(spec.w), F.lit(-1.0))).alias("future")).where("future is not null")
    labelled = rows.join(F.broadcast(thresholds)).withColumn("y", (F.col("future") >= F.col("cut")).cast("int"))
    return scores_by(labelled, ["threshold_name"])


def shuffled_labels(df: DataFrame, seeds: int, keys: Sequence[str], y: str = "y") -> DataFrame:
    """(seed, p, y): labels permuted by pairing the order of a hash with the order of the keys."""
    from panelyard.operators.refits import permuted

    numbered, labels = permuted(df.select(*keys, y, "p"), seeds, keys, y)
    return labels.join(numbered.select("_n", "p").hint("merge"), "_n").select("seed", "p", "y")


def permutation_null(df: DataFrame, seeds: int, keys: Sequence[str], y: str = "y") -> DataFrame:
    """AUC of a score against the AUCs under permuted labels: mean, standard deviation and z."""
    own = roc_auc(df.withColumn("_one", F.lit(1)), ["_one"], y, "p").select(F.col("roc_auc").alias("true_auc"))
    null = roc_auc(shuffled_labels(df, seeds, keys, y), ["seed"], "y", "p").agg(F.avg("roc_auc").alias("null_mean"), F.stddev_pop("roc_auc").alias("null_sd"))
    return own.crossJoin(F.broadcast(null)).withColumn("z", (F.col("true_auc") - F.col("null_mean")) / F.nullif(F.col("null_sd"), F.lit(0.0)))


def delayed_rows(df: DataFrame, delays: Sequence[int], horizon: int, p: str = "inc", spec: PanelSpec = DEFAULT) -> DataFrame:
    """(delay, p, y): the score of d weeks ago beside the label of today."""
    late = F.array(*(F.struct(F.lit(d).alias("delay"), F.first(p).over(spec.by_day.rangeBetween(-7 * d, -7 * d)).alias("p")) for d in delays))
    ahead = F.datediff(F.lead(spec.week, horizon).over(spec.w), F.col(spec.week)) == 7 * horizon
    y = F.when(ahead, at_least(F.lead(spec.rate, horizon).over(spec.w), F.col("thr")).cast("int"))
    rows = df.select(y.alias("y"), late.alias("late")).where("y is not null").select("y", F.explode("late").alias("l")).select("y", "l.delay", "l.p")
    return rows.where("p is not null")


def reporting_delay_stress(df: DataFrame, delays: Sequence[int], horizon: int, p: str = "inc", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Metrics when the score of d weeks ago must serve; lead in days."""
    return scores_by(delayed_rows(df, delays, horizon, p, spec), ["delay"]).withColumn("lead_days", 7 * (horizon + F.col("delay")))


def lag_contamination_check(df: DataFrame, stored: str, column: str, weeks: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Share of rows where a stored lag equals the value found anew by date."""
    again = F.first(column).over(spec.by_day.rangeBetween(-7 * weeks, -7 * weeks))
    return df.withColumn("_same", F.col(stored).eqNullSafe(again)).agg(F.count("*").alias("n"), F.avg(F.col("_same").cast("double")).alias("share_equal"))


def leakage_audit(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """n, and the least share over pairs (stored, found anew by date) of rows where both are equal."""
    shares = [F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")) for a, b in pairs]
    return df.agg(F.count("*").alias("n"), F.array_min(F.array(*shares)).alias("share_equal"))


def stratified_folds(df: DataFrame, key: str, y: str, k: int, repeats: int) -> DataFrame:
    """``fold`` for each repeat: classes are dealt evenly, in the order of a hash."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    hashed = rows.withColumn("_h", hash_number(F.col(key), F.col("repeat")))
    ran = running(hashed, ["repeat", y], "_h", {"_n": F.lit(1)}, order=[F.col(key)])
    return ran.withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_h", "_n")
