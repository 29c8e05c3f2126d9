"""Triage and serving queries: bands, verdicts, boards, leaderboards, table differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scans import running
from panelyard.operators.metrics import ranking_scores, share

# Names of bands and of triage groups in their order of display.
BANDS = ("Low", "Moderate", "High", "Very High")
GROUPS = ("In outbreak", "Outbreak likely", "Clear", "Not assessable")


def risk_band(p: Column) -> Column:
    """Band of a risk; null where there is none."""
    return F.when(p.isNull(), None).when(p <= 0.25, BANDS[0]).when(p <= 0.5, BANDS[1]).when(p <= 0.75, BANDS[2]).otherwise(BANDS[3])


def assess_frame(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds triage, headline_risk, band, assessable and reason.

    Needs currently_in_outbreak, continuation_risk and emergence_risk, null meaning "not asked".
    """
    now, quiet = F.coalesce("currently_in_outbreak", F.lit(False)), F.col("emergence_risk").isNull()
    likely = F.col("emergence_risk") >= threshold
    pct = f"{threshold:.0%}"
    pick = lambda a, b, c, d: F.when(now, a).when(quiet, d).when(likely, b).otherwise(c)
    headline = F.when(now, F.col("continuation_risk")).otherwise(F.col("emergence_risk"))
    return df.withColumns({
        "triage": pick(*(F.lit(g) for g in GROUPS)), "headline_risk": headline, "band": risk_band(headline), "assessable": now | ~quiet,
        "reason": pick(F.lit("already above the outbreak level"), F.lit(f"chance of crossing is {pct} or more"), F.lit(f"chance of crossing is below {pct}"), F.lit("not quiet long enough to be asked")),
    })


def triage_counts(assessed: DataFrame) -> DataFrame:
    """Rows in each group in a fixed order, empty groups included."""
    order = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(g).alias("triage")) for k, g in enumerate(GROUPS)))
    groups = assessed.sparkSession.range(1).select(F.explode(order).alias("g")).select("g.*")
    return groups.join(F.broadcast(assessed.groupBy("triage").count()), "triage", "left").select("place", "triage", F.coalesce("count", F.lit(0)).alias("n"))


def relative_bands(p: Column, threshold: float) -> Column:
    """Bands around a threshold, right-closed; edges that coincide lose the last labels."""
    edges = sorted({0.0, threshold / 2, threshold, threshold + (1 - threshold) / 2, 1.0})
    out = F.when((p < edges[0]) | p.isNull(), None)
    for label, top in zip(BANDS, edges[1:], strict=False):
        out = out.when(p <= top, label)
    return out


def latest_per_entity(df: DataFrame, columns: Sequence[str], weeks: int = 2, fill: bool = False, entity: str = "entity", week: str = "week_start") -> DataFrame:
    """The last row of each entity in the last weeks; ``fill`` takes each column's last value that is there."""
    last = df.agg(F.max(week).alias("_last"))
    recent = df.join(F.broadcast(last), F.col(week) > F.date_sub(F.col("_last"), 7 * weeks)).drop("_last")
    if fill:
        return recent.groupBy(entity).agg(F.max(week).alias(week), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(week))).alias(c) for c in columns))
    return recent.groupBy(entity).agg(F.max_by(F.struct(week, *columns), week).alias("_row")).select(entity, "_row.*")


def entity_history_tail(df: DataFrame, n: int, entity: str = "entity", week: str = "week_start") -> DataFrame:
    """The last ``n`` rows of each entity."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(week)))).where(F.col("_n") <= n).drop("_n")


def triage_board(assessed: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows of each group by headline risk, with place in and size of the group; a group is dealt out in ranges."""
    return running(assessed, ["triage"], "headline_risk", {"place": F.lit(1)}, order=[F.col(entity)], descending=True, totals={"place": "group_size"})


def case_area_advice(patients: DataFrame, areas: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Advice for a patient flag and the risk of the area: (patient, area, flag) and (area, risk)."""
    joined = patients.join(areas, "area", "left")
    high, flag = F.col("risk") >= threshold, F.coalesce("flag", F.lit(False))
    advice = (
        F.when(F.col("risk").isNull() & flag, "no outbreak forecast; confirm").when(F.col("risk").isNull(), "no outbreak forecast; routine care").when(flag & high, "confirm and start vector control")
        .when(flag, "confirm").when(high, "maintain surveillance").otherwise("routine care")
    )
    return joined.withColumn("advice", advice)


def arms(df: DataFrame, scores: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, arm, p): several scores of the same rows, one below the other."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(c).cast("double").alias("p")) for a, c in scores.items())))
    return df.select(*keys, "y", each.alias("a")).select(*keys, "y", "a.arm", "a.p")


def model_leaderboard(df: DataFrame, scores: dict[str, str], baseline: str) -> DataFrame:
    """Average precision and ROC AUC of each score, the baseline's on the same rows, and the lift over it."""
    long = arms(df, scores)
    table = ranking_scores(long, ["arm"])  # a row for each arm
    base = table.where(F.col("arm") == baseline).select(F.col("ap").alias("baseline_ap"))
    return table.crossJoin(F.broadcast(base)).withColumns({"lift": share(F.col("ap"), F.col("baseline_ap"), None), "rank": F.row_number().over(Window.orderBy(F.desc("ap"), "arm"))})


def lift_over_trivial(points: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Each operating point beside what never flagging gives, and which point has the best recall."""
    both = points.crossJoin(F.broadcast(prevalence))
    best = Window.orderBy(F.desc("recall"), "target")
    return both.select(
        "target", "recall", "precision", "npv", (1 - F.col("prevalence")).alias("trivial_npv"), F.lit(0.0).alias("trivial_recall"), F.lit(0.5).alias("trivial_roc_auc"),
        (F.col("npv") - (1 - F.col("prevalence"))).alias("npv_gain"), (F.row_number().over(best) == 1).alias("best_recall"),
    )


def validation_battery(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, value, n, alarm) of several results (value, n, alarm), of one row or of one for each ``part``; a check without rows gives none."""
    out = None
    for name, df in checks.items():
        full = F.concat_ws("_", F.lit(name), F.col("part").cast("string")) if "part" in df.columns else F.lit(name)
        part = df.select(full.alias("check"), F.col("value").cast("double"), F.col("n").cast("long"), F.col("alarm").cast("boolean")).where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out


def metric_delta(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """before, after and delta by key; rows without an after value go."""
    b = before.select(*keys, F.col("value").alias("before"))
    a = after.select(*keys, F.col("value").alias("after"))
    return b.join(a, list(keys), "right").where("after is not null").withColumn("delta", F.col("after") - F.col("before"))


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], decimals: int = 10) -> DataFrame:
    """Cells that differ at a number of decimals: only_left, only_right or changed."""
    def cells(df: DataFrame, name: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), decimals).alias("v")) for c in columns)))
        return df.select(*keys, each.alias("c")).select(*keys, "c.column", F.col("c.v").alias(name), F.lit(True).alias(f"in_{name}"))

    both = cells(left, "left_value").join(cells(right, "right_value").hint("merge"), [*keys, "column"], "full")
    kind = F.when(F.col("in_right_value").isNull(), "only_left").when(F.col("in_left_value").isNull(), "only_right").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed")
    return both.withColumn("kind", kind).where("kind is not null").drop("in_left_value", "in_right_value")


def key_coverage(df: DataFrame, entities: DataFrame, entity: str = "entity", week: str = "week_start") -> DataFrame:
    """Expected keys (all entities, all weeks seen) against those present: missing, undeclared and duplicate, by entity."""
    span = df.agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    expected = entities.select(entity).crossJoin(F.broadcast(span)).select(entity, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias(week))
    missing = expected.join(df.select(entity, week).hint("merge"), [entity, week], "left_anti").select(entity, F.lit("missing").alias("kind"))
    undeclared = df.join(entities.select(entity).hint("merge"), entity, "left_anti").select(entity, F.lit("undeclared").alias("kind"))
    duplicate = df.groupBy(entity, week).count().where("count > 1").select(entity, F.lit("duplicate").alias("kind"))
    return missing.unionByName(undeclared).unionByName(duplicate).groupBy(entity, "kind").agg(F.count("*").alias("n"))
