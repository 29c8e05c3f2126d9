"""The example panel and its companions, built from the star-schema tables.

Returned line items play the part of cases, quantities that of exposure, nations
that of places. ``CTE`` says the same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scans import quantiles, written

THRESHOLD_SHARE = 0.85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the place of their supplier (a dimension of bounded columns, joined by shuffle or by size)."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return items.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").cast("long").alias("entity"), F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("entity", "day").agg(F.sum("l_quantity").alias("exposure_a"), F.avg("l_extendedprice").alias("exposure_b"), F.avg("l_discount").alias("exposure_c"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("population"))
    n = F.col("n_nationkey").cast("long")
    return (
        table(spark, sf_dir, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            n.alias("entity"), F.col("n_name").alias("entity_name"), F.col("n_regionkey").cast("long").alias("n_regionkey"), (5.0 + 0.4 * n).alias("lat"),
            (79.0 + 0.3 * ((n * 7) % 25)).alias("lon"), (100 + 37 * n).alias("area"), F.coalesce("population", F.lit(0)).alias("population"),
        )
    )


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("entity", monday(F.col("day")).alias("week_start")).agg(F.count_if(F.col("l_returnflag") == "R").alias("cases"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.operators.panel import weekly_exposure_rollup

    return weekly_exposure_rollup(daily(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.operators.panel import panel_join

    joined = panel_join(cases(spark, sf_dir), weekly(spark, sf_dir), meta(spark, sf_dir).select("entity", "population", "area"))
    return joined.withColumn("inc", F.col("cases") * 1e5 / F.greatest("population", F.lit(1))).withColumn("yr", F.year("week_start").cast("long"))


def panel_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``panel`` from one pass over the line items: a week that has cases has exposure, so both come from one roll-up."""
    from panelyard.operators.panel import weekly_exposure_rollup

    days = lines(spark, sf_dir).groupBy("entity", "day").agg(F.sum("l_quantity").alias("exposure_a"), F.avg("l_extendedprice").alias("exposure_b"), F.avg("l_discount").alias("exposure_c"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    weeks = weekly_exposure_rollup(days, {"cases": F.sum("returned")})
    # a row for each place
    joined = weeks.join(F.broadcast(meta(spark, sf_dir).select("entity", "population", "area")), "entity", "left")
    return joined.withColumn("inc", F.col("cases") * 1e5 / F.greatest("population", F.lit(1))).withColumn("yr", F.year("week_start").cast("long"))


def with_threshold(df: DataFrame, share: float = THRESHOLD_SHARE, rate: str = "inc", name: str = "thr") -> DataFrame:
    """``thr``: an exact quantile of the rate over all rows, the same for every row."""
    cut = quantiles(df, rate, [share]).select(F.get("q", F.lit(0)).alias(name))
    return df.crossJoin(F.broadcast(cut))


def hot_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.spec import at_least

    # written: read once for the threshold and once for the rows
    return with_threshold(written(panel_once(spark, sf_dir))).withColumn("hot", at_least(F.col("inc"), F.col("thr")).cast("int"))


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second report of the cases: every fifth week missing, some counts off by one."""
    no = F.floor(F.datediff("week_start", F.lit("1995-01-02").cast("date")) / 7)
    rows = cases(spark, sf_dir).withColumn("week_no", no).where("week_no % 5 <> 0")
    return rows.withColumn("cases", F.when((F.col("entity") * 31 + F.col("week_no")) % 40 == 0, F.col("cases") + 1).otherwise(F.col("cases"))).drop("week_no")


CTE = """WITH daily AS (SELECT s_nationkey::BIGINT entity, l_shipdate::date "day", sum(l_quantity) exposure_a,
    avg(l_extendedprice) exposure_b, avg(l_discount) exposure_c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1,2),
meta AS (SELECT n_nationkey::BIGINT entity, n_name entity_name, n_regionkey::BIGINT n_regionkey, 5.0::DOUBLE+0.4::DOUBLE*n_nationkey lat,
    79.0::DOUBLE+0.3::DOUBLE*((n_nationkey*7)%25) lon, (100+37*n_nationkey)::BIGINT area,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) population FROM nation),
cases AS (SELECT s_nationkey::BIGINT entity, date_trunc('week', l_shipdate)::date week_start,
    sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END)::bigint cases
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1,2),
wk AS (SELECT entity, date_trunc('week', "day")::date week_start, sum(exposure_a) a_sum, avg(exposure_a) a_mean,
    max(exposure_a) a_max, count(*) FILTER (exposure_a >= 25) a_days, avg(exposure_b) b_mean,
    max(exposure_b) b_max, min(exposure_b) b_min, avg(exposure_c) c_mean FROM daily GROUP BY 1,2),
panel AS (SELECT c.entity, c.week_start, c.cases, wk.* EXCLUDE (entity, week_start), m.population, m.area,
    c.cases*1e5/greatest(m.population,1) inc, year(c.week_start) yr
  FROM cases c JOIN wk USING (entity, week_start) LEFT JOIN meta m USING (entity)),
hp AS (SELECT *, (SELECT quantile_cont(inc, 0.85) FROM panel) thr,
    (inc >= (SELECT quantile_cont(inc, 0.85) FROM panel))::INT hot FROM panel),
second AS (SELECT entity, week_start, CASE WHEN (entity*31 + datediff('day', DATE '1995-01-02', week_start)//7) % 40 = 0
    THEN cases + 1 ELSE cases END cases FROM cases WHERE (datediff('day', DATE '1995-01-02', week_start)//7) % 5 <> 0)
"""
