"""How a query and its SQL twin are stated, and the fixtures that several share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.scans import running, written
from panelyard.operators import features, labels
from panelyard.plans.fixtures import CTE, hot_panel


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers to bigint: what two engines can agree on.

    The cut lies a little off the half, where exact decimals would tie.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            c = F.floor(c.cast("double") * 1e6 + 0.50012) / 1e6
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, run: Callable[[SparkSession, str], DataFrame], select: str | None = None, doubles: str = "", longs: str = "", ctes: str = "", base: str = CTE) -> Query:
    """``select`` over ``base`` and further ``ctes``; named columns are rounded or cast as ``tidy`` does."""
    sql = None
    if select is not None:
        swaps = [f'(floor("{c}"::DOUBLE * 1e6::DOUBLE + 0.50012::DOUBLE) / 1e6::DOUBLE)::DOUBLE AS "{c}"' for c in doubles.split()] + [f'"{c}"::BIGINT AS "{c}"' for c in longs.split()]
        replace = f" REPLACE ({', '.join(swaps)})" if swaps else ""
        sql = f"{base}{ctes} SELECT *{replace} FROM ({select}) _q"
    return Query(name, lambda spark, sf_dir: tidy(run(spark, sf_dir)), sql)


# -- rows labelled for emergence, with three scores ---------------------------------------

LAB = """, lab AS (SELECT *, coalesce(hot = 0 AND lag(hot,1) OVER w = 0 AND lag(hot,2) OVER w = 0, false) eligible,
    CASE WHEN count(hot) OVER f = 4 AND datediff('day', week_start, lead(week_start,4) OVER w) = 28 THEN max(hot) OVER f END y,
    coalesce(CASE WHEN lead(hot,1) OVER w = 1 THEN 1 END, CASE WHEN lead(hot,2) OVER w = 1 THEN 2 END,
             CASE WHEN lead(hot,3) OVER w = 1 THEN 3 END, CASE WHEN lead(hot,4) OVER w = 1 THEN 4 END) ahead,
    inc p1, inc * coalesce(cases / greatest(lag(cases,1) OVER w, CASE WHEN lag(cases,1) OVER w IS NULL THEN NULL ELSE 1.0::DOUBLE END), 1.0::DOUBLE) p2,
    coalesce(CASE WHEN count(cases) OVER b = 4 THEN avg(cases) OVER b END / greatest(population, 1) * 1e5, 0.0::DOUBLE) p3
  FROM hp WINDOW w AS (PARTITION BY entity ORDER BY week_start),
    f AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
    b AS (PARTITION BY entity ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
scored AS (SELECT entity, week_start, yr, cases, inc, population, area, n_regionkey, a_sum, thr, y, p1, p2, p3, CASE WHEN y = 1 THEN ahead END weeks_to_crossing
  FROM lab JOIN (SELECT entity, n_regionkey FROM meta) USING (entity) WHERE eligible AND y IS NOT NULL)
"""

# A score between 0 and 1: place of p3 among all scored rows.
SCALED = """, scaled AS (SELECT *, cume_dist() OVER (ORDER BY p3) p FROM scored)
"""


def labelled(spark: SparkSession, sf_dir: str, hot: DataFrame | None = None) -> DataFrame:
    """All panel rows with eligibility, label, lead and the three scores p1, p2, p3; ``hot``: the rows of ``hot_panel``, if they are there already."""
    rows = labels.emergence_label(hot_panel(spark, sf_dir) if hot is None else hot, keep_ineligible=True)
    rows = features.naive_baselines(labels.weeks_to_crossing(rows))
    return rows.withColumnsRenamed({"persistence": "p1", "growth_product": "p2", "moving_average": "p3"})


def scored(spark: SparkSession, sf_dir: str, hot: DataFrame | None = None) -> DataFrame:
    from panelyard.plans.fixtures import meta

    # written, since most queries read these rows several times
    rows = labelled(spark, sf_dir, hot).where("eligible and y is not null").join(F.broadcast(meta(spark, sf_dir).select("entity", "n_regionkey")), "entity")
    return written(rows.select("entity", "week_start", "yr", "cases", "inc", "population", "area", "n_regionkey", "a_sum", "thr", "y", "p1", "p2", "p3", "weeks_to_crossing"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with ``p``: the share of rows whose p3 is not higher, from counts by distinct score."""
    return with_share(scored(spark, sf_dir), "p3", "p")


def with_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name``: the share of rows whose value is not higher; rows without a value are left out."""
    by = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    upto = running(by, [], column, {"_upto": F.col("_n")}, totals={"_upto": "_rows"})
    # one row for each distinct value, so joined by shuffle
    return df.join(upto.select(column, (F.col("_upto") / F.col("_rows")).alias(name)).hint("merge"), column)
