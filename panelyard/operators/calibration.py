"""Calibration as column expressions, and scoring helpers that need no fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scans import quantiles
from panelyard.operators.metrics import population_medians


def step_table(df: DataFrame, y: str = "y", p: str = "p", bins: int = 20) -> DataFrame:
    """(upper, level): mean label up to each quantile of the score, made monotone by running maxima; a few rows."""
    cut = quantiles(df, p, [k / bins for k in range(1, bins + 1)]).select(F.array_distinct("q").alias("e"))
    placed = df.crossJoin(F.broadcast(cut)).withColumn("bin", F.least(F.size(F.filter("e", lambda x: x < F.col(p))), F.size("e") - 1))
    by = placed.groupBy("bin").agg(F.avg(y).alias("m"), F.max(p).alias("upper"))
    return by.select("upper", F.max("m").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("level"))


def tie_broken_calibration(df: DataFrame, steps: DataFrame, p: str = "p") -> DataFrame:
    """``q``: the level of the score's step plus a small rising term that keeps the order of scores inside a step.

    The term is below half the least gap between levels, and at most 1e-6. ``steps``: a few rows.
    """
    gap = F.min(F.when(F.col("g") > 0, F.col("g")))
    gaps = steps.select("level").distinct().select((F.col("level") - F.lag("level").over(Window.orderBy("level"))).alias("g")).agg(F.coalesce(F.least(F.greatest(gap / 2, F.lit(1e-9)), F.lit(1e-6)), F.lit(1e-6)).alias("eps"))
    table = steps.agg(F.array_sort(F.collect_list(F.struct("upper", "level"))).alias("steps")).crossJoin(gaps)
    spread = quantiles(df, p, [0.25, 0.5, 0.75]).withColumnRenamed("q", "q4")
    rows = df.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(spread))
    inside = F.filter("steps", lambda s: s["upper"] >= F.col(p))
    level = F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["level"]).otherwise(F.element_at("steps", -1)["level"])
    scale = F.greatest(F.col("q4")[2] - F.col("q4")[0], F.lit(1e-12))
    term = F.col("eps") * (0.5 + F.atan((F.col(p) - F.col("q4")[1]) / scale) / F.pi())
    return rows.withColumn("q", apply_calibrator(level + term)).drop("steps", "eps", "q4")


def apply_calibrator(q: Column, fitted: bool = True) -> Column:
    """A probability clipped to 0..1; passed through if there is no calibrator."""
    return F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) if fitted else q


def batch_prepare(df: DataFrame, cohort: DataFrame, needed: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Missing inputs from the cohort's medians, columns in the model's order; also the names that ``df`` lacks."""
    lacking = [c for c in needed if c not in df.columns]
    medians = population_medians(cohort, needed).select(*(F.col(c).alias(f"_m_{c}") for c in needed))
    rows = df.crossJoin(F.broadcast(medians))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) if c in df.columns else F.col(f"_m_{c}") for c in needed}
    return rows.withColumns(filled).select(*order), lacking
