"""Running sums, row numbers and exact quantiles of whole tables, without one task that sees all rows.

Rows are dealt into ranges of their whole order (keys, value, then what breaks ties) by
Spark's range partitioning, and written with the number of their range. Sums run inside
each range, and the totals of the ranges before it (a table of one row for each key and
range) are added. Where the ranges are cut only decides how even they are, so results are
exact. Equal values are split wherever the order goes on behind the value.

``running`` and ``quantiles`` write below ``spark.checkpoint.dir`` when they are called;
whoever clears that folder clears these tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only for a local master, since executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or LOCAL_FOLDER).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder ``spark.checkpoint.dir``: later plans read it, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: Column | str, name: str = "_range") -> DataFrame:
    """``df``, written, with the number of a row's range; it rises with ``order``. Rows that are equal in it share a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], *, order: Sequence[Column] = (), descending: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums in the order of ``value`` (then ``order``) within ``keys``, the current row included.

    ``totals``: names for the sums over all rows of a key, by the name of the running sum.
    """
    first = F.desc(value) if descending else F.asc(value)
    dealt = in_ranges(df, *keys, first, *order)
    line = Window.partitionBy(*keys, "_range").orderBy(first, *order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({f"_in_{k}": F.sum(c).over(line) for k, c in sums.items()})
    per = dealt.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_at")).agg(*(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    own = [f"_key_{k}" for k in keys]
    before = Window.partitionBy(*own).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*own)
    ahead = per.select(*own, "_at", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums), *(F.sum(f"_sum_{k}").over(whole).alias(f"_all_{k}") for k in (totals or {})))
    met = F.col("_range") == F.col("_at")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = inside.join(ahead.hint("merge"), met)
    ran = [(F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums]
    return joined.select(*df.columns, *ran, *(F.col(f"_all_{k}").alias(name) for k, name in (totals or {}).items()))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """One row (keys, q) for each key that has a value: exact quantiles by linear interpolation."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ran = running(by, keys, "v", {"upto": F.col("n")}, totals={"upto": "rows"})
    asked = F.array(*(F.lit(float(s)) for s in shares))
    place = lambda s: s * (F.col("rows") - 1).cast("double")
    low, high = (lambda s: F.floor(place(s)) + 1), (lambda s: F.ceil(place(s)) + 1)
    ranks = F.array_distinct(F.concat(F.transform(asked, low), F.transform(asked, high)))
    hit = ran.select(*keys, "v", "rows", F.explode(F.filter(ranks, lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))).alias("rank"))
    # two ranks for each share at most
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"), F.max("rows").alias("rows"))

    def one(s: Column) -> Column:
        a, b = F.element_at("at", low(s)), F.element_at("at", high(s))
        return F.when(a == b, a).otherwise((high(s) - 1 - place(s)) * a + (place(s) - (low(s) - 1)) * b)

    return found.select(*keys, F.when(F.col("rows").isNotNull(), F.transform(asked, one)).alias("q"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row (q): the exact quantiles of a column by linear interpolation; null if it has no value."""
    return quantiles_by(df, [], value, shares)
