"""Metrics and thresholds.

Score curves are sums over distinct scores, then running sums; keys (fold, arm,
draw, feature) and ranges of scores partition them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scans import quantiles, quantiles_by, running


def share(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """A ratio, and a stated value where nothing is below."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def curve(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", weight: Column | None = None) -> DataFrame:
    """For each key and distinct score: positives and rows at it, at or above it, and in all."""
    weight = F.lit(1) if weight is None else weight
    by = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).alias("score")).agg(F.sum(weight * F.col(y)).alias("pos"), F.sum(weight).alias("all"))
    return running(by, keys, "score", {"tp": F.col("pos"), "flagged": F.col("all")}, descending=True, totals={"tp": "positives", "flagged": "rows"})


def pos_weight(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """Negatives over positives, at least one positive."""
    return df.groupBy(*keys).agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("pos_weight"))


def confusion(flag: Column, y: str = "y") -> list[Column]:
    hit = F.col(y) == 1
    return [F.count_if(flag & hit).alias("tp"), F.count_if(~flag & hit).alias("fn"), F.count_if(flag & ~hit).alias("fp"), F.count_if(~flag & ~hit).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Rates from tp, fn, fp, tn; 0 where the denominator is."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    recall, spec_ = share(tp, tp + fn), share(tn, tn + fp)
    return df.withColumns({
        "recall": recall, "precision": share(tp, tp + fp), "specificity": spec_, "npv": share(tn, tn + fn),
        "accuracy": share(tp + tn, tp + fn + fp + tn), "balanced_accuracy": (recall + spec_) / 2,
    })


def confusion_at_threshold(df: DataFrame, threshold: Column | float, keys: Sequence[str] = (), y: str = "y", p: str = "p", week: str | None = None) -> DataFrame:
    """Counts and rates for p >= threshold; with ``week``, also flags per week."""
    flag = F.col(p) >= threshold
    extra = [F.countDistinct(week).alias("n_weeks")] if week else []
    out = rates(df.groupBy(*keys).agg(*confusion(flag, y), *extra))
    return out.withColumn("flagged_per_week", (F.col("tp") + F.col("fp")) / F.greatest("n_weeks", F.lit(1))) if week else out


def _ap() -> Column:
    return F.coalesce(F.sum(F.when(F.col("positives") > 0, F.col("pos") / F.col("positives") * F.col("tp") / F.nullif(F.col("flagged"), F.lit(0)))), F.lit(0.0)).alias("ap")


def _roc_auc() -> Column:
    negatives = F.col("rows") - F.col("positives")
    below = negatives - (F.col("flagged") - F.col("tp"))
    wins = F.sum(F.col("pos") * (below + (F.col("all") - F.col("pos")) / 2))
    return F.try_divide(wins.cast("double"), (F.first("positives") * F.first(negatives)).cast("double")).alias("roc_auc")


def average_precision(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", weight: Column | None = None) -> DataFrame:
    """Sum over distinct scores of recall gained times precision; 0 without positives."""
    return curve(df, keys, y, p, weight).groupBy(*keys).agg(_ap())


def rank_average_precision(df: DataFrame, keys: Sequence[str], order: Sequence[Column], y: str = "y", p: str = "p") -> DataFrame:
    """The rank form: every row on its own, ties in a stated order; 0 without positives."""
    ranked = running(df, keys, p, {"_n": F.lit(1), "_tp": F.col(y)}, order=order, descending=True)
    by = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(y) == 1, F.col("_tp") / F.col("_n"))).alias("_sum"), F.sum(y).alias("_pos"))
    return by.select(*keys, share(F.col("_sum"), F.col("_pos")).alias("ap_rank"))


def roc_auc(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Mann-Whitney with ties at half; null unless both classes occur."""
    return curve(df, keys, y, p).groupBy(*keys).agg(_roc_auc())


def ranking_scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """``average_precision`` and ``roc_auc`` side by side, from one curve."""
    return curve(df, keys, y, p).groupBy(*keys).agg(_ap(), _roc_auc())


def threshold_for_sensitivity(df: DataFrame, keys: Sequence[str], target: Column | float = 0.9, y: str = "y", p: str = "p") -> DataFrame:
    """Highest score whose recall reaches the target; 0 (flag all) if there are no positives."""
    c = curve(df, keys, y, p)
    reached = F.max(F.when((F.col("positives") > 0) & (F.col("tp") / F.nullif(F.col("positives"), F.lit(0)) >= target), F.col("score")))
    return c.groupBy(*keys).agg(F.coalesce(reached, F.lit(0.0)).alias("threshold"))


def quantile_grid(df: DataFrame, shares: Sequence[float], p: str = "p") -> DataFrame:
    """The distinct quantiles of a score, one row each."""
    return quantiles(df, p, shares).select(F.explode(F.array_distinct("q")).alias("t"))


def counts_at(df: DataFrame, grid: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """tp, flagged and totals for each threshold of a small grid, in one pass over the rows.

    A row counts at its place among the sorted thresholds; running sums do the rest.
    """
    cuts = grid.agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda t: t <= F.col(p))).alias("place")).agg(F.sum(y).alias("pos"), F.count("*").alias("all"))
    down = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    # one row for each threshold from here on
    every = cuts.select(F.posexplode("cuts").alias("at", "t")).select((F.col("at") + 1).alias("place"), "t").unionByName(cuts.select(F.lit(0).alias("place"), F.lit(None).cast("double").alias("t")))
    filled = every.join(F.broadcast(placed), "place", "left").fillna(0, ["pos", "all"])
    ran = filled.withColumns({"tp": F.sum("pos").over(down), "flagged": F.sum("all").over(down), "positives": F.sum("pos").over(whole), "rows": F.sum("all").over(whole)})
    return ran.where("t is not null").select("t", "tp", "flagged", "positives", "rows")


def threshold_for_f1(df: DataFrame, shares: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """Quantile with the best F1, the larger on ties; 0.5 if there is only one class."""
    c = counts_at(df, quantile_grid(df, shares, p), y, p)
    f1 = share(2.0 * F.col("tp"), F.col("flagged") + F.col("positives"))
    best = c.agg(F.max(F.struct(f1.alias("f1"), "t")).alias("b"), F.max((F.col("positives") > 0) & (F.col("positives") < F.col("rows"))).alias("both"))
    return best.select(F.when(F.col("both"), F.col("b.t")).otherwise(0.5).alias("threshold"), F.when(F.col("both"), F.col("b.f1")).alias("f1"))


def best_balanced_threshold(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Observed score with the best balanced accuracy, the lowest on ties; 0.5 if there is one class."""
    c = curve(df, keys, y, p)
    negatives = F.col("rows") - F.col("positives")
    bal = (share(F.col("tp"), F.col("positives")) + share(negatives - (F.col("flagged") - F.col("tp")), negatives)) / 2
    best = c.groupBy(*keys).agg(F.min(F.struct((-bal).alias("b"), F.col("score").alias("t"))).alias("m"), F.first("positives").alias("pos"), F.first("rows").alias("n"))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return best.select(*keys, F.when(both, F.col("m.t")).otherwise(0.5).alias("threshold"), F.when(both, -F.col("m.b")).alias("balanced_accuracy"))


def brier_score(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*keys).agg(F.avg(F.pow(clipped - F.col(y), 2)).alias("brier"))


def reliability_table(df: DataFrame, bins: int = 15, y: str = "y", p: str = "p") -> DataFrame:
    """n, mean score and mean label in bins of equal counts; edges that coincide are one."""
    cut = quantiles(df, p, [k / bins for k in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = df.crossJoin(F.broadcast(cut)).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(p))))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(df: DataFrame, bins: int = 15, y: str = "y", p: str = "p") -> DataFrame:
    """Mean distance of label and score over the bins, weighted by rows."""
    return reliability_table(df, bins, y, p).agg((F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def alerts_at_recall(df: DataFrame, target: float, week: str, y: str = "y", p: str = "p") -> DataFrame:
    """The cheapest operating point that reaches a recall."""
    cut = threshold_for_sensitivity(df.withColumn("_one", F.lit(1)), ["_one"], target, y, p).select("threshold")
    return confusion_at_threshold(df.crossJoin(F.broadcast(cut)), F.col("threshold"), ["threshold"], y, p, week)


def threshold_for_budget(df: DataFrame, budgets: Sequence[float], week: str, p: str = "p") -> DataFrame:
    """For each alerts-a-week budget the k-th largest score, k rounded half to even and at least 1; the least score if k is all."""
    n = df.agg(F.count("*").alias("n"), F.countDistinct(week).alias("n_weeks"), F.min(p).alias("low"))
    asked = n.select("n", "low", "n_weeks", F.explode(F.array(*(F.lit(float(b)) for b in budgets))).alias("per_week"))
    asked = asked.withColumn("k", F.greatest(F.bround(F.col("per_week") * F.greatest("n_weeks", F.lit(1))).cast("long"), F.lit(1).cast("long")))
    by = df.groupBy(F.col(p).alias("score")).agg(F.count("*").alias("all"))
    down = running(by, [], "score", {"upto": F.col("all")}, descending=True)
    # asked: a row for each budget
    found = down.join(F.broadcast(asked), F.col("upto") >= F.col("k")).groupBy("per_week", "k", "n", "low").agg(F.max("score").alias("kth"))
    return asked.join(F.broadcast(found.select("per_week", "kth")), "per_week", "left").select("per_week", "k", F.when(F.col("k") >= F.col("n"), F.col("low")).otherwise(F.col("kth")).alias("threshold"))


def top_k_by_week(df: DataFrame, k: int, week: str, order: Sequence[Column], p: str = "p") -> DataFrame:
    """``flag``: among the k highest scores of its week."""
    line = Window.partitionBy(week).orderBy(F.desc(p), *order)
    return df.withColumn("flag", F.row_number().over(line) <= k)


def operating_point_sweep(val: DataFrame, test: DataFrame, targets: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """Thresholds from validation rows for several recalls, counts and rates on test rows."""
    asked = F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target")
    cuts = threshold_for_sensitivity(val.select(y, p, asked), ["target"], F.col("target"), y, p)
    return confusion_at_threshold(test.join(F.broadcast(cuts)), F.col("threshold"), ["target", "threshold"], y, p)


def budget_sweep(val: DataFrame, test: DataFrame, budgets: Sequence[int], week: str, y: str = "y", p: str = "p") -> DataFrame:
    """Thresholds from validation rows for alerts-a-week budgets, rates and mean lead on test rows."""
    cuts = threshold_for_budget(val, budgets, week, p).select("per_week", "threshold")
    joined = test.join(F.broadcast(cuts))
    flag = F.col(p) >= F.col("threshold")
    lead = F.avg(F.when(flag & (F.col(y) == 1), F.col("weeks_to_crossing"))).alias("mean_lead")
    return rates(joined.groupBy("per_week", "threshold").agg(*confusion(flag, y), lead))


def alert_policy_global(df: DataFrame, shares: Sequence[float], week: str, y: str = "y", p: str = "p") -> DataFrame:
    """Recall, precision and alerts a week at quantile thresholds."""
    weeks = df.agg(F.countDistinct(week).alias("n_weeks"))
    c = counts_at(df, quantile_grid(df, shares, p), y, p).crossJoin(F.broadcast(weeks))
    return c.select("t", share(F.col("tp"), F.col("positives")).alias("recall"), share(F.col("tp"), F.col("flagged")).alias("precision"), (F.col("flagged") / F.col("n_weeks")).alias("alerts_per_week"))


def alert_policy_topk(df: DataFrame, most: int, week: str, order: Sequence[Column], y: str = "y", p: str = "p") -> DataFrame:
    """The same when the k highest of each week are flagged, k = 1..most; ranked once."""
    line = Window.partitionBy(week).orderBy(F.desc(p), *order)
    ranked = df.select(week, y, F.row_number().over(line).alias("rank"))
    whole = ranked.agg(F.countDistinct(week).alias("n_weeks"), F.sum(y).alias("positives"))
    by = ranked.where(F.col("rank") <= most).groupBy("rank").agg(F.sum(y).alias("pos"), F.count("*").alias("all"))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ran = by.select(F.col("rank").alias("k"), F.sum("pos").over(up).alias("tp"), F.sum("all").over(up).alias("flagged")).crossJoin(F.broadcast(whole))
    return ran.select("k", share(F.col("tp"), F.col("positives")).alias("recall"), share(F.col("tp"), F.col("flagged")).alias("precision"), (F.col("flagged") / F.col("n_weeks")).alias("alerts_per_week"))


def cheapest_policy(policies: DataFrame, target: float = 0.9) -> DataFrame:
    """Fewest alerts that reach a recall, for each policy: (policy, setting, recall, precision, alerts_per_week)."""
    ok = policies.where(F.col("recall") >= target)
    best = ok.groupBy("policy").agg(F.min(F.struct("alerts_per_week", "setting", "recall", "precision")).alias("b"))
    return best.select("policy", "b.setting", "b.recall", "b.precision", "b.alerts_per_week")


def strata(df: DataFrame, buckets: dict[str, Column], flag: Column, y: str = "y") -> DataFrame:
    """n, positives, recall, precision, misses and false alarms for each stratum and bucket."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("stratum"), b.cast("string").alias("bucket")) for k, b in buckets.items())))
    rows = df.select(y, flag.alias("_flag"), each.alias("s")).select(y, "_flag", "s.*")
    out = rates(rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"), *confusion(F.col("_flag"), y)))
    return out.select("stratum", "bucket", "n", (F.col("tp") + F.col("fn")).alias("outbreaks"), "recall", "precision", "fn", "fp")


def momentum_errors(df: DataFrame, flag: Column, already: Column, y: str = "y") -> DataFrame:
    """Share of false alarms, and of true negatives, on rows already at epidemic level."""
    return df.withColumns({"_flag": flag, "_on": already.cast("double")}).agg(
        F.avg(F.when(F.col("_flag") & (F.col(y) == 0), F.col("_on"))).alias("false_alarm_share"), F.avg(F.when(~F.col("_flag") & (F.col(y) == 0), F.col("_on"))).alias("true_negative_share")
    )


def melted(df: DataFrame, columns: Sequence[str], y: str = "y") -> DataFrame:
    """(feature, value, y) for all columns in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(F.col(y).alias("y"), each.alias("f")).select("f.feature", "f.value", "y").where("value is not null")


def single_feature_auc(df: DataFrame, columns: Sequence[str], y: str = "y", least: int = 20) -> DataFrame:
    """AUC of each column either way round; columns with few rows or one class are left out."""
    rows = melted(df, columns, y)
    enough = rows.groupBy("feature").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).where(f"n >= {least} and lo < hi").select("feature", "n")
    auc = roc_auc(rows, ["feature"], "y", "value").join(enough.hint("merge"), "feature")
    return auc.select("feature", "n", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))


def range_overlap(df: DataFrame, columns: Sequence[str], y: str = "y", least: int = 5) -> DataFrame:
    """Range of each column by class and whether the ranges overlap."""
    v = F.col("value")
    by = melted(df, columns, y).groupBy("feature").agg(
        *(f(F.when(F.col("y") == k, v)).alias(f"{name}{k}") for k in (0, 1) for name, f in (("min", F.min), ("max", F.max), ("n", F.count)))
    )
    kept = by.where(f"n0 >= {least} and n1 >= {least}")
    return kept.select("feature", "min0", "max0", "min1", "max1", ((F.col("min0") <= F.col("max1")) & (F.col("min1") <= F.col("max0"))).alias("overlaps"))


def dataset_audit(df: DataFrame, columns: Sequence[str], y: str = "y", alarm: float = 0.95) -> DataFrame:
    """Columns that tell the label apart too well, and REJECT if there are any."""
    leaky = single_feature_auc(df, columns, y).where(F.col("auc") >= alarm).agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("leaky"))
    apart = range_overlap(df, columns, y).where("not overlaps").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("disjoint"))
    return leaky.crossJoin(apart).withColumn("verdict", F.when((F.col("leaky") == "") & (F.col("disjoint") == ""), "PASS").otherwise("REJECT"))


def quantile_row(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row with the exact quantiles of each column, an array each; all columns in one pass."""
    q = quantiles_by(melted(df.withColumn("_y", F.lit(0)), columns, "_y"), ["feature"], "value", shares)
    return q.agg(*(F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns))


def population_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantile_row(df, columns, [0.5]).select(*(F.get(c, F.lit(0)).alias(c) for c in columns))


def rank_average(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean of two scores' ranks, ties at their average rank, within each key; a null ranks first.

    Ranks come from counts by distinct score, joined back; no task sees a whole key.
    """
    def with_rank(rows: DataFrame, c: str, name: str) -> DataFrame:
        by = df.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        ran = running(by, keys, c, {"_upto": F.col("_n")}).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(c).alias("_at"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
        met = F.col(c).eqNullSafe(F.col("_at"))
        for i, k in enumerate(keys):
            met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(ran.hint("merge"), met).drop("_at", *(f"_k{i}" for i in range(len(keys))))

    ranked = with_rank(with_rank(df, a, "_rank_a"), b, "_rank_b")
    return ranked.withColumn("rank_mean", (F.col("_rank_a") + F.col("_rank_b")) / 2).drop("_rank_a", "_rank_b")
