"""Sources: case reports, daily exposure, indices, coded tables, report text and links."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_dates(value: Column, formats: Sequence[str]) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(f)).cast("date") for f in formats))


def scan_cases_weekly(rows: DataFrame, date_format: str = "MM/dd/yyyy") -> DataFrame:
    """(entity, week_start, cases) from text columns entity, start_date and cases: bad dates go, bad counts are 0."""
    day = parse_dates(F.col("start_date"), [date_format])
    count = F.coalesce(F.col("cases").try_cast("double"), F.lit(0.0)).cast("long")
    clean = rows.select(F.col("entity").cast("long").alias("entity"), day.alias("day"), count.alias("cases")).where("day is not null")
    return clean.groupBy("entity", F.date_trunc("week", "day").cast("date").alias("week_start")).agg(F.sum("cases").alias("cases"))


def read_cases_csv(spark: SparkSession, path: str) -> DataFrame:
    return scan_cases_weekly(spark.read.csv(path, header=True, schema="entity string, start_date string, cases string"))


def read_daily_exposure(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files, one or more for each entity."""
    return spark.read.schema(schema).parquet(path)


def scan_pruned(df: DataFrame, wanted: Sequence[str], keep: Column) -> DataFrame:
    """Those wanted columns that exist, filtered; both reach the Parquet scan."""
    return df.where(keep).select(*(c for c in wanted if c in df.columns))


def explode_series_json(df: DataFrame, key: str, payload: str, missing: float = -999.0) -> DataFrame:
    """(key, day, parameter, value) from {"parameter": {"yyyymmdd": value}}; a sentinel is null."""
    maps = F.from_json(F.col(payload), "map<string,map<string,double>>")
    each = df.select(key, F.explode(maps).alias("parameter", "series")).select(key, "parameter", F.explode("series").alias("day", "value"))
    return each.select(key, F.try_to_timestamp("day", F.lit("yyyyMMdd")).cast("date").alias("day"), "parameter", F.nullif(F.col("value"), F.lit(missing)).alias("value"))


def parse_fixed_width_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """(year, month, anom) from lines ``YEAR MONTH TOTAL ADJUSTED ANOMALY``; headers and short lines go."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 5) & F.col("p")[0].rlike(r"^\d{4}$"))
    return rows.select(F.col("p")[0].try_cast("int").alias("year"), F.col("p")[1].try_cast("int").alias("month"), F.col("p")[4].try_cast("double").alias("anom")).where("month is not null and anom is not null")


def unpivot_monthly_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """(year, month, anom) from lines of a year and twelve values; values below -90 are missing."""
    parts = F.split(F.trim(column), r"\s+")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 13) & F.col("p")[0].rlike(r"^\d{4}$"))
    long = rows.select(F.col("p")[0].try_cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("i", "v"))
    return long.select("year", (F.col("i") + 1).alias("month"), F.col("v").try_cast("double").alias("anom")).where("anom >= -90")


def source_fallback(sources: Sequence[DataFrame], least: int = 240) -> DataFrame:
    """The first source with more than ``least`` rows."""
    stacked = None
    for k, df in enumerate(sources):
        part = df.withColumn("priority", F.lit(k))
        stacked = part if stacked is None else stacked.unionByName(part)
    chosen = stacked.groupBy("priority").count().where(F.col("count") > least).agg(F.min("priority").alias("priority"))
    return stacked.join(F.broadcast(chosen), "priority")


def optional_columns(df: DataFrame, key: str, other: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Join an optional source; without it the columns are null."""
    if other is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in columns})
    return df.join(other.select(key, *columns), key, "left")


def load_binary_coded(df: DataFrame, target: str, drop: Sequence[str]) -> DataFrame:
    """Target = (code 2); columns whose values are only 1 and 2 become 1 and 0; stated columns go.

    Which columns are coded so takes one aggregate over all of them.
    """
    columns = [c for c in df.columns if c not in {target, *drop}]
    within = df.agg(*(F.coalesce(F.bool_and(F.col(c).isin(1, 2)), F.lit(False)).alias(c) for c in columns)).first()
    recoded = [(F.when(F.col(c) == 1, 1).when(F.col(c) == 2, 0) if within[c] else F.col(c)).alias(c) for c in columns]
    return df.select((F.col(target) == 2).cast("int").alias("y"), *recoded)


def load_dedup_recode(df: DataFrame, label: str, positive: str, gender: str) -> DataFrame:
    """Exact duplicates go; label by a word, gender 0 or 1."""
    return df.dropDuplicates().withColumns({"y": (F.lower(label) == positive).cast("int"), gender: F.when(F.lower(gender) == "male", 1).when(F.lower(gender) == "female", 0)})


def load_map_recode(df: DataFrame, label: str, column: str, codes: dict[str, int]) -> DataFrame:
    """Rows without label go; a column by a map, -1 for anything else."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return df.na.drop(subset=[label]).withColumn(f"{column}_code", F.coalesce(F.try_element_at(table, F.col(column)), F.lit(-1)))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``<column>_code``: place of the value among the sorted distinct values, -1 for null."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = values.withColumn(f"{column}_code", F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(coded, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))


def list_report_links(pages: DataFrame, pattern: str, number: str, limit: int, html: str = "html", key: str = "page_id") -> DataFrame:
    """(link, number) of the links on index pages that fit: first of each number, highest numbers first."""
    links = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "link"))
    numbered = links.withColumn("number", F.regexp_extract("link", number, 1).try_cast("int")).where("number is not null")
    first = numbered.groupBy("number").agg(F.min_by("link", F.struct(key, "pos")).alias("link"))
    return first.orderBy(F.desc("number")).limit(limit)


def glyph_runs(glyphs: DataFrame, width: float = 3.0) -> DataFrame:
    """Text of each column of glyphs (page, x0, top, ch): columns by rounded x, read from the largest top down."""
    bucket = F.bround(F.col("x0") / width).cast("int")
    runs = glyphs.groupBy("page", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("o"), "ch"))).alias("g"), F.min("x0").alias("x"))
    text = F.trim(F.array_join(F.transform("g", lambda g: g["ch"]), ""))
    return runs.select("page", "x", text.alias("run")).where("run <> ''")


def alias_canonicalise(df: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """The canonical name of the longest alias that begins the text; null if none does. ``aliases``: (alias, canonical), a small table."""
    hits = df.join(F.broadcast(aliases), F.lower(text).startswith(F.lower("alias")), "left")
    return hits.groupBy(*df.columns).agg(F.max_by("canonical", F.struct(F.length("alias"), "alias")).alias("canonical"))


def rows_from_runs(runs: DataFrame, aliases: DataFrame, least: int = 8, near: float = 6.0) -> DataFrame:
    """Rows of a table printed sideways: (page, x, run) to (page, canonical, numbers).

    A run that begins with a name and has enough numbers is a row; a bare name takes
    the nearest run of numbers on its page, each used once.
    """
    counted = runs.withColumn("numbers", F.regexp_extract_all("run", F.lit(r"(\d+)"), F.lit(1)))
    named = alias_canonicalise(counted, "run", aliases)
    full = named.where(F.col("canonical").isNotNull() & (F.size("numbers") >= least)).select("page", "canonical", "numbers")
    bare = named.where(F.col("canonical").isNotNull() & (F.size("numbers") < least)).select("page", F.col("x").alias("name_x"), "canonical")
    loose = named.where(F.col("canonical").isNull() & (F.size("numbers") >= least)).select("page", "x", "numbers")
    pairs = bare.join(loose.hint("merge"), "page").where(F.abs(F.col("x") - F.col("name_x")) < near).withColumn("d", F.abs(F.col("x") - F.col("name_x")))
    best = pairs.withColumn("n", F.row_number().over(Window.partitionBy("page", "name_x", "canonical").orderBy("d", "x"))).where("n = 1")
    once = best.withColumn("m", F.row_number().over(Window.partitionBy("page", "x").orderBy("d", "name_x"))).where("m = 1")
    return full.unionByName(once.select("page", "canonical", "numbers"))


# Month names of report captions.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or a beginning of three letters or more, in any case; null for others."""
    word = F.lower(name)
    place = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: m.startswith(word)), True)
    return F.when((F.length(word) >= 3) & (place > 0), place)


def parse_caption_weeks(df: DataFrame, caption: str) -> DataFrame:
    """(week_start, week_end) of captions such as ``1st-7th March 2024``, ``29th Jan - 04th Feb 2025``, ``28 Sept. — 4 Oct. 2024`` and ``30 December 2023 - 5 January 2024``."""
    day, month, year = r"(\d{1,2})(?i:st|nd|rd|th)?", r"([A-Za-z]{3,})\.?", r"(\d{4})"
    dash = r"\s*[-–—]\s*"
    text = F.col(caption)

    def date(d: Column, m: Column, y: Column) -> Column:
        number = month_number(m)
        return F.when(number > 0, F.try_to_timestamp(F.concat_ws("-", y, number.cast("string"), d), F.lit("yyyy-M-d")).cast("date"))

    def form(pattern: str, start: tuple, stop: tuple) -> tuple[Column, Column]:
        g = lambda k: F.regexp_extract(text, pattern, k)
        made = [F.when(text.rlike(pattern), date(*(g(k) for k in x))) for x in (start, stop)]
        # half a range is none
        return tuple(F.when(made[0].isNotNull() & made[1].isNotNull(), x) for x in made)

    forms = [
        form(rf"{day}\s*{month}\s+{year}{dash}{day}\s*{month}\s+{year}", (1, 2, 3), (4, 5, 6)),
        form(rf"{day}\s*{month}{dash}{day}\s*{month}\s+{year}", (1, 2, 5), (3, 4, 5)),
        form(rf"{day}{dash}{day}\s*{month}\s+{year}", (1, 3, 4), (2, 3, 4)),
    ]
    start, stop = (F.coalesce(*(f[k] for f in forms)) for k in (0, 1))
    # a range over the turn of the year that states one year begins in the year before
    return df.withColumns({"week_start": F.when(start > stop, F.add_months(start, -12)).otherwise(start), "week_end": stop})


def parse_table_rows(docs: DataFrame, key: str, text: str, names: Sequence[str] | Mapping[str, str], least: int = 20) -> DataFrame:
    """(key, name, prev_week, cases, cumulative) from a known name and six numbers behind it; ``Nil`` is 0.

    A row may stand anywhere in a line, behind words or stray letters; a name may have an
    asterisk, any case and any white space inside. ``names``: the names, or spellings with
    the name that each stands for. The third number is the week before, the fourth this
    week, the sixth the running total; a row with a seventh number is none. The first row
    of a name counts; documents with too few names go.
    """
    known = dict(names) if isinstance(names, Mapping) else {n: n for n in names}
    spelled = "|".join(r"\s+".join(map(re.escape, n.split())) for n in sorted(known, key=len, reverse=True))
    # all cells behind a name are taken; how many there are is looked at below
    pattern = rf"(?i)\b({spelled})\*?((?:[ \t]+(?:[\d,]+|nil)\*?(?!\w))++)"
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "row"))
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    # the names are a small dimension
    canonical = F.create_map(*(F.lit(x) for n, c in known.items() for x in (" ".join(n.lower().split()), c)))
    cells = F.split(F.trim(F.regexp_replace(F.regexp_extract("row", pattern, 2), "\t", " ")), " +")
    value = lambda k: F.regexp_replace(F.regexp_replace(F.get(cells, F.lit(k)), "[,*]", ""), "(?i)^Nil$", "0").try_cast("long")
    rows = found.where(F.size(cells) == 6).select(key, "pos", F.element_at(canonical, plain(F.regexp_extract("row", pattern, 1))).alias("name"), value(2).alias("prev_week"), value(3).alias("cases"), value(5).alias("cumulative"))
    first = rows.groupBy(key, "name").agg(F.min_by(F.struct("prev_week", "cases", "cumulative"), "pos").alias("r")).select(key, "name", "r.*")
    enough = first.groupBy(key).count().where(F.col("count") >= least).select(key)
    return first.join(enough.hint("merge"), key)


def extract_stated_total(df: DataFrame, text: str, phrase: str) -> DataFrame:
    """``stated_total``: the number before a phrase, null when absent."""
    found = F.regexp_extract(text, r"([\d,]+)\s+" + phrase, 1)
    return df.withColumn("stated_total", F.nullif(F.regexp_replace(found, ",", ""), F.lit("")).try_cast("long"))


def nested_json_metrics(df: DataFrame, key: str, payload: str, schema: str, paths: dict[str, str]) -> DataFrame:
    """Named numbers out of nested JSON; missing keys give null."""
    parsed = df.select(key, F.from_json(F.col(payload), schema).alias("j"))
    return parsed.select(key, *(F.col(f"j.{path}").cast("double").alias(name) for name, path in paths.items()))


def write_outputs(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result table as Parquet, CSV or JSON."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True), "json": writer.json}[kind](path)
