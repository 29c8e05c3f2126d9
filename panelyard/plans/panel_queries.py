"""Panel construction and source queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import panel as P
from panelyard.plans import fixtures as fx
from panelyard.plans.base import query
from panelyard.sources import readers as R
from panelyard.streaming.incremental import work_dir

WEEK_NO = "(datediff('day', DATE '1995-01-02', week_start)//7)"
PANEL_DOUBLES = "a_sum a_mean a_max b_mean b_max b_min c_mean"


def week_no(c="week_start"):
    return F.floor(F.datediff(F.col(c), F.lit("1995-01-02").cast("date")) / 7)


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.cases(spark, sf), fx.second_source(spark, sf)


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly cases written in each format below the shared folder, and read again."""
    rows, where, found = fx.cases(spark, sf).select("entity", "week_start", "cases"), work_dir(spark), None
    for kind in ("parquet", "csv", "json"):
        R.write_outputs(rows, f"{where}/{kind}", kind)
        reader = spark.read.schema(rows.schema).option("header", kind == "csv")
        again = reader.format(kind).load(f"{where}/{kind}").withColumn("kind", F.lit(kind))
        found = again if found is None else found.unionByName(again)
    return found


def stated(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with the weekly total that a report would state: off by 5 % every tenth week, absent every thirteenth."""
    rows = fx.cases(spark, sf)
    total = rows.groupBy("week_start").agg(F.sum("cases").alias("t"))
    n = week_no()
    value = F.when(n % 13 == 0, None).when(n % 10 == 0, F.col("t") * 1.05).otherwise(F.col("t").cast("double"))
    return rows.join(total.select("week_start", value.alias("stated_total")), "week_start")


STATED = f""", stated AS (SELECT c.*, CASE WHEN {WEEK_NO} % 13 = 0 THEN NULL WHEN {WEEK_NO} % 10 = 0 THEN t * 1.05::DOUBLE ELSE t::DOUBLE END stated_total
  FROM cases c JOIN (SELECT week_start, sum(cases)::BIGINT t FROM cases GROUP BY 1) USING (week_start)),
checks AS (SELECT week_start, stated_total, sum(cases)::BIGINT parsed_total, abs(sum(cases) - stated_total)::DOUBLE / greatest(stated_total, CASE WHEN stated_total IS NULL THEN NULL ELSE 1.0::DOUBLE END) rel_diff
  FROM stated GROUP BY 1, 2)
"""
DIFFS = """, diffs AS (SELECT a.entity, a.week_start, a.cases cases_a, b.cases cases_b, abs(a.cases - b.cases) abs_diff, abs(a.cases - b.cases)::DOUBLE / greatest(b.cases, 1) rel_diff
  FROM cases a JOIN second b USING (entity, week_start))
"""


def dated_text(spark: SparkSession, sf: str) -> DataFrame:
    """Cases as text: dates in two formats by week parity and a bad date every fiftieth week; bad counts now and then."""
    n = week_no()
    day = F.when(n % 50 == 0, "not a date").when(n % 2 == 0, F.date_format("week_start", "MM/dd/yyyy")).otherwise(F.date_format("week_start", "yyyy-MM-dd"))
    return fx.cases(spark, sf).withColumns({"start_date": day, "n": n})


DATED = f""", dated AS (SELECT *, {WEEK_NO} n, CASE WHEN {WEEK_NO} % 50 = 0 THEN 'not a date' WHEN {WEEK_NO} % 2 = 0 THEN strftime(week_start, '%m/%d/%Y') ELSE strftime(week_start, '%Y-%m-%d') END start_date FROM cases)
"""


def scan_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = dated_text(spark, sf).select(F.col("entity").cast("string").alias("entity"), "start_date", F.when(F.col("n") % 7 == 0, "n/a").otherwise(F.col("cases").cast("string")).alias("cases"))
    return R.scan_cases_weekly(rows)


def series_json(spark: SparkSession, sf: str) -> DataFrame:
    """Daily exposure of a place as the JSON that a weather service would send, sentinel included."""
    d = fx.daily(spark, sf).withColumn("k", F.date_format("day", "yyyyMMdd")).withColumn("v", F.when(F.dayofmonth("day") == 13, -999.0).otherwise(F.round("exposure_a", 2)))
    entry = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    by = d.groupBy("entity", F.year("day").alias("y")).agg(F.to_json(F.create_map(F.lit("PREC"), entry)).alias("payload"))
    return R.explode_series_json(by, "entity", "payload")


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders")
    month = orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("m"))
    return month.crossJoin(F.broadcast(orders.agg(F.avg("o_totalprice").alias("a")))).select("year", "month", F.round((F.col("m") - F.col("a")) / 1000, 2).alias("anom"))


INDEX = """, idx AS (SELECT year(o_orderdate) "year", month(o_orderdate) "month", round((avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders)) / 1000, 2) anom FROM orders GROUP BY 1, 2)
"""


def fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    line = F.format_string("  %d  %2d  %8.2f %8.2f %8.2f", "year", "month", F.lit(1.0), F.lit(2.0), "anom")
    head = spark.range(1).select(F.lit(" YR MON TOTAL ADJ ANOM").alias("value"))
    return head.unionByName(index_rows(spark, sf).select(line.alias("value")))


def month_lines(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when((F.col("month") + F.col("year")) % 9 == 0, F.lit(-99.9)).otherwise(F.col("anom"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("month", F.format_string("%.2f", value).alias("t")))), lambda x: x["t"])
    by = index_rows(spark, sf).groupBy("year").agg(cells.alias("c")).where(F.size("c") == 12)
    return by.select(F.concat_ws("  ", F.col("year").cast("string"), F.array_join("c", "  ")).alias("value"))


def report_text(spark: SparkSession, sf: str) -> DataFrame:
    """One report for each week: a caption, a line for each place, the total; numbers known from the panel."""
    rows = fx.cases(spark, sf).join(F.broadcast(fx.meta(spark, sf).select("entity", "entity_name")), "entity")
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("week_start")
    rows = rows.withColumns({"prev": F.coalesce(F.lag("cases").over(w), F.lit(0)), "cum": F.sum("cases").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    n = lambda c: F.when(F.col(c) == 0, "Nil").otherwise(F.concat(F.format_number(F.col(c), 0), F.when(F.col(c) % 5 == 0, "*").otherwise("")))
    line = F.concat_ws(" ", "entity_name", F.lit("11"), F.lit("12"), n("prev"), n("cases"), F.lit("1,234"), n("cum"))
    by = rows.groupBy("week_start").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.sum("cases").alias("total"), F.count("*").alias("places"))
    end = F.date_add("week_start", 6)
    day = lambda d: F.date_format(d, "d")
    same_month = F.month("week_start") == F.month(end)
    same_year = F.year("week_start") == F.year(end)
    caption = (
        F.when(same_month, F.concat(day("week_start"), F.lit("th - "), day(end), F.lit("th "), F.date_format(end, "MMMM yyyy")))
        .when(same_year, F.concat(day("week_start"), F.lit(" "), F.date_format("week_start", "MMMM"), F.lit(" - "), day(end), F.lit(" "), F.date_format(end, "MMMM yyyy")))
        .otherwise(F.concat(day("week_start"), F.lit(" "), F.date_format("week_start", "MMMM yyyy"), F.lit(" - "), day(end), F.lit(" "), F.date_format(end, "MMMM yyyy")))
    )
    text = F.concat(F.col("lines"), F.lit("\n"), F.format_number("total", 0), F.lit(" cases were reported"))
    return by.select(F.col("week_start").alias("truth"), caption.alias("caption"), text.alias("text"), "places", "total")


def caption_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Captions with short months, dots, long dashes, ordinals and a title before them, by the number of the week."""
    rep = report_text(spark, sf).withColumn("no", F.datediff("truth", F.lit("1995-01-02").cast("date")) / 7)
    full = F.col("caption")
    short = F.regexp_replace(full, r"\b(January|February|March|April|June|July|August|October|November|December)\b", "@$1")
    short = F.regexp_replace(F.regexp_replace(short, r"@(\w{3})\w*", "$1."), "September", "Sept.")
    kind = F.col("no").cast("int") % 4
    made = F.when(kind == 0, full).when(kind == 1, short).when(kind == 2, F.regexp_replace(F.upper(short), " - ", " — ")).otherwise(F.concat(F.lit("Table 1: Week 7 ("), F.regexp_replace(full, " - ", "–"), F.lit(") of 25 places")))
    return R.parse_caption_weeks(rep.select("truth", made.alias("caption")), "caption").select("truth", "week_start", "week_end")


def inline_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows run together with sentences, with stray letters, asterisks and other spellings of names."""
    rep = report_text(spark, sf)
    names = place_names(spark, sf)
    spelled = {n: n for n in names} | {n.title()[:4] + ".": n for n in names if sum(m[:4] == n[:4] for m in names) == 1}
    line = lambda x, k: F.when(k % 4 == 0, x).when(k % 4 == 1, F.concat(F.lit("n "), F.regexp_replace(x, r"^(\D*\S) (11 12)", "$1* $2"))).when(k % 4 == 2, F.lower(x)).otherwise(F.regexp_replace(x, " ", "   "))
    text = F.array_join(F.transform(F.split("text", "\n"), line), " reported by phone. ")
    return R.parse_table_rows(rep.select("truth", text.alias("text")), "truth", "text", spelled, 20)


REPORT = """, rep AS (SELECT c.*, entity_name, coalesce(lag(cases) OVER w, 0) prev, sum(cases) OVER w cum FROM cases c JOIN meta USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY week_start)),
places AS (SELECT week_start, count(*) n FROM rep GROUP BY 1)
"""


def place_names(spark: SparkSession, sf: str) -> list[str]:
    """Names of the places, a dimension of 25 rows."""
    return [x[0] for x in fx.table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]


def glyphs(spark: SparkSession, sf: str) -> DataFrame:
    """The report lines of all weeks as positioned glyphs, one column of x for each line."""
    lines = report_text(spark, sf).select("truth", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    chars = lines.select(F.col("truth").alias("page"), (3.0 * F.col("line")).alias("x0"), F.posexplode(F.split("t", "")).alias("pos", "ch"))
    return chars.where("ch <> ''").select("page", "x0", (-F.col("pos")).cast("double").alias("top"), "ch")


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical")).unionByName(n.select(F.substring("n_name", 1, 3).alias("alias"), F.concat(F.substring("n_name", 1, 3), F.lit("*")).alias("canonical")).groupBy("alias").agg(F.min("canonical").alias("canonical")))


def docs_codes(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang")).alias("lang"))
    return R.category_codes(d, "lang").select("doc_id", "lang_code")


def binary_coded(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_custkey") % 2 + 1).alias("coded"), (F.col("c_custkey") % 3 + 1).alias("graded"), (F.col("c_nationkey") % 2 + 1).cast("int").alias("grp"), F.lit("x").alias("note")
    )
    return R.load_binary_coded(c, "grp", ["note"])


def dedup_recode(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "Positive").otherwise("negative").alias("result"), F.when(F.col("o_custkey") % 3 == 0, "Male").when(F.col("o_custkey") % 3 == 1, "FEMALE").otherwise("?").alias("gender"), (F.col("o_custkey") % 50).alias("k")
    )
    return R.load_dedup_recode(o, "result", "positive", "gender").select("k", "gender", "y")


def map_recode(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_custkey") % 2).alias("label"), "c_mktsegment")
    return R.load_map_recode(c, "label", "c_mktsegment", {"AUTOMOBILE": 0, "BUILDING": 1, "MACHINERY": 2}).select("c_custkey", "label", "c_mktsegment_code")


def json_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = R.nested_json_metrics(fx.table(spark, sf, "events"), "event_type", "props", "k double, missing struct<a: double>", {"k": "k", "absent": "missing.a"})
    return e.groupBy("event_type").agg(F.avg("k").alias("mean_k"), F.count("absent").alias("n_absent"), F.count("*").alias("n"))


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both(spark, sf)
    return P.freshness_stats({"first": a, "second": b.where(week_no() < 300)}, F.lit("2001-12-01").cast("date"))


def rows_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Name runs and number runs set apart by 2, as a sideways table prints them."""
    g = R.glyph_runs(glyphs(spark, sf))
    name = F.regexp_extract("run", r"^([A-Z]\S*)\s", 1)
    numbers = F.regexp_extract("run", r"^[A-Z]\S*\s+(.*)$", 1)
    rows = g.where(name != "").select("page", "x", name.alias("name"), numbers.alias("nums"))
    apart = rows.select("page", (F.col("x") * 5).alias("x"), F.col("name").alias("run")).unionByName(rows.select("page", (F.col("x") * 5 + 2).alias("x"), F.concat(F.lit("- "), "nums", F.lit(" 0 0 0")).alias("run")))
    names = fx.table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    return R.rows_from_runs(apart, names, 8).select("page", "canonical", F.array_join("numbers", " ").alias("numbers"))


QUERIES = [
    # sources
    query("scan_cases_weekly", scan_cases, f"SELECT entity, date_trunc('week', week_start)::DATE week_start, sum(CASE WHEN {WEEK_NO} % 7 = 0 THEN 0 ELSE cases END) cases FROM dated WHERE start_date LIKE '%/%' GROUP BY 1, 2", longs="cases", ctes=DATED),
    query("parse_mixed_dates", lambda s, d: dated_text(s, d).select("entity", "start_date", R.parse_dates(F.col("start_date"), ["MM/dd/yyyy", "yyyy-MM-dd"]).alias("parsed")), "SELECT entity, start_date, coalesce(try_strptime(start_date, '%m/%d/%Y')::DATE, try_strptime(start_date, '%Y-%m-%d')::DATE) parsed FROM dated", ctes=DATED),
    query("scan_daily_exposure", fx.daily, "SELECT * FROM daily", "exposure_a exposure_b exposure_c"),
    query("scan_panel_pruned", lambda s, d: R.scan_pruned(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "absent"], F.col("l_quantity") >= 45), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45", "l_quantity", "l_linenumber"),
    query("explode_series_json", series_json, """SELECT entity, "day", 'PREC' "parameter", CASE WHEN day("day") = 13 THEN NULL ELSE round(exposure_a, 2) END "value" FROM daily""", "value"),
    query("parse_fixed_width_index", lambda s, d: R.parse_fixed_width_index(fixed_width(s, d)), "SELECT * FROM idx", "anom", "year month", INDEX),
    query("unpivot_monthly_index", lambda s, d: R.unpivot_monthly_index(month_lines(s, d)), 'SELECT * FROM idx WHERE ("month" + "year") % 9 <> 0 AND "year" IN (SELECT "year" FROM idx GROUP BY 1 HAVING count(*) = 12)', "anom", "year month", INDEX),
    query("source_fallback", lambda s, d: R.source_fallback([index_rows(s, d).where("year < 1996"), index_rows(s, d).where("year >= 1994")], 30), 'SELECT 1 priority, * FROM idx WHERE "year" >= 1994', "anom", "priority year month", INDEX),
    query("optional_source_nulls", lambda s, d: R.optional_columns(fx.cases(s, d), "entity", None, ["nino", "trend"]), "SELECT *, NULL::DOUBLE nino, NULL::DOUBLE trend FROM cases"),
    query("load_binary_coded", binary_coded, "SELECT (c_nationkey % 2 + 1 = 2)::INT y, c_custkey, CASE WHEN c_custkey % 2 + 1 = 1 THEN 1 ELSE 0 END coded, c_custkey % 3 + 1 graded FROM customer", longs="y c_custkey coded graded"),
    query("load_dedup_recode", dedup_recode, "SELECT DISTINCT k, gender, y FROM (SELECT DISTINCT o_custkey % 50 k, CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END gender, (o_orderstatus = 'F')::INT y FROM orders)", longs="k gender y"),
    query("load_map_recode", map_recode, "SELECT c_custkey, c_custkey % 2 \"label\", CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE -1 END c_mktsegment_code FROM customer WHERE c_custkey % 7 <> 0", longs="label c_mktsegment_code"),
    query("category_codes", docs_codes, "SELECT doc_id, CASE WHEN lang IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 END lang_code FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang END lang FROM documents)", longs="lang_code"),
    query("list_report_links", lambda s, d: R.list_report_links(fx.table(s, d, "pages").withColumn("html", F.concat(F.lit('<a href="/vol/'), (F.col("page_id") % 90).cast("string"), F.lit('/r'), F.col("page_id").cast("string"), F.lit('.pdf">'), "html")), r'href="([^"]*\.pdf)"', r"/vol/(\d+)/", 50), "SELECT '/vol/' || (page_id % 90) || '/r' || page_id || '.pdf' link, page_id % 90 number FROM pages WHERE page_id < 90 ORDER BY number DESC LIMIT 50", longs="number"),
    query("glyph_runs", lambda s, d: R.glyph_runs(glyphs(s, d)).where("run not like '%cases were reported'").select("page", "run"), "SELECT week_start page, entity_name || ' 11 12 ' || (CASE WHEN prev = 0 THEN 'Nil' ELSE format('{:,}', prev::BIGINT) || CASE WHEN prev % 5 = 0 THEN '*' ELSE '' END END) || ' ' || (CASE WHEN cases = 0 THEN 'Nil' ELSE format('{:,}', cases) || CASE WHEN cases % 5 = 0 THEN '*' ELSE '' END END) || ' 1,234 ' || (CASE WHEN cum = 0 THEN 'Nil' ELSE format('{:,}', cum::BIGINT) || CASE WHEN cum % 5 = 0 THEN '*' ELSE '' END END) run FROM rep", ctes=REPORT),
    query("alias_canonicalise", lambda s, d: R.alias_canonicalise(fx.table(s, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" 12 3")).alias("run")), "run", aliases(s, d)), "SELECT lower(n_name) || ' 12 3' run, n_name canonical FROM nation"),
    query("rows_from_runs", rows_runs, "SELECT week_start page, entity_name canonical, '11 12 ' || regexp_replace(CASE WHEN prev = 0 THEN '' ELSE replace(format('{:,}', prev::BIGINT), ',', ' ') || ' ' END || CASE WHEN cases = 0 THEN '' ELSE replace(format('{:,}', cases), ',', ' ') || ' ' END || '1 234 ' || CASE WHEN cum = 0 THEN '' ELSE replace(format('{:,}', cum::BIGINT), ',', ' ') || ' ' END, '\\s+', ' ', 'g') || '0 0 0' numbers FROM rep WHERE (prev > 0)::INT + (cases > 0)::INT + (cum > 0)::INT >= 1", ctes=REPORT),
    query("parse_caption_weeks", lambda s, d: R.parse_caption_weeks(report_text(s, d), "caption").select("caption", "week_start", "week_end"), "SELECT CASE WHEN month(week_start) = month(week_start + INTERVAL 6 DAY) THEN day(week_start) || 'th - ' || day(week_start + INTERVAL 6 DAY) || 'th ' || strftime(week_start, '%B %Y') WHEN year(week_start) = year(week_start + INTERVAL 6 DAY) THEN day(week_start) || ' ' || strftime(week_start, '%B') || ' - ' || day(week_start + INTERVAL 6 DAY) || ' ' || strftime(week_start + INTERVAL 6 DAY, '%B %Y') ELSE day(week_start) || ' ' || strftime(week_start, '%B %Y') || ' - ' || day(week_start + INTERVAL 6 DAY) || ' ' || strftime(week_start + INTERVAL 6 DAY, '%B %Y') END caption, week_start, (week_start + INTERVAL 6 DAY)::DATE week_end FROM places", ctes=REPORT),
    query("parse_caption_forms", caption_forms, "SELECT week_start truth, week_start, (week_start + INTERVAL 6 DAY)::DATE week_end FROM places", ctes=REPORT),
    query("parse_table_rows_inline", inline_rows, "SELECT week_start truth, entity_name \"name\", prev prev_week, cases, cum cumulative FROM rep JOIN places USING (week_start) WHERE n >= 20", longs="prev_week cases cumulative", ctes=REPORT),
    query("parse_table_rows", lambda s, d: R.parse_table_rows(report_text(s, d), "truth", "text", place_names(s, d), 20), "SELECT week_start truth, entity_name \"name\", prev prev_week, cases, cum cumulative FROM rep JOIN places USING (week_start) WHERE n >= 20", longs="prev_week cases cumulative", ctes=REPORT),
    query("extract_stated_total", lambda s, d: R.extract_stated_total(report_text(s, d), "text", "cases were reported").select("truth", "stated_total"), "SELECT week_start truth, sum(cases) stated_total FROM rep GROUP BY 1", longs="stated_total", ctes=REPORT),
    query("nested_json_metrics", json_metrics, "SELECT event_type, avg((props->>'$.k')::DOUBLE) mean_k, 0 n_absent, count(*) n FROM events GROUP BY 1", "mean_k", "n_absent n"),
    query("write_outputs", outputs, "SELECT entity, week_start, cases, k kind FROM cases, (VALUES ('parquet'), ('csv'), ('json')) v(k)", longs="cases"),
    # panels
    query("snap_to_week", lambda s, d: P.snap_to_week(fx.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day"), "SELECT o_orderkey, o_orderdate::DATE \"day\", date_trunc('week', o_orderdate)::DATE week_start FROM orders"),
    query("weekly_counts", lambda s, d: P.weekly_counts(fx.lines(s, d), "entity", "day", (F.col("l_returnflag") == "R").cast("long")), "SELECT * FROM cases"),
    query("weekly_exposure_rollup", fx.weekly, "SELECT * FROM wk", PANEL_DOUBLES),
    query("panel_join", fx.panel, "SELECT * FROM panel", PANEL_DOUBLES + " inc", "yr"),
    query("panel_rates", lambda s, d: P.panel_rates(fx.panel(s, d)).select("entity", "week_start", "density", "incidence", "year"), "SELECT entity, week_start, population / nullif(area, 0) density, cases / nullif(population, 0) * 1e5 incidence, yr \"year\" FROM panel", "density incidence", "year"),
    query("merge_source_priority", lambda s, d: P.merge_source_priority(list(both(s, d))[::-1], ["second", "first"]), "SELECT entity, week_start, coalesce(b.cases, a.cases) cases, CASE WHEN b.cases IS NULL THEN 'first' ELSE 'second' END \"source\", isoyear(week_start) iso_year, weekofyear(week_start) iso_week, strftime(week_start, '%m/%d/%Y') start_date, strftime(week_start + INTERVAL 6 DAY, '%m/%d/%Y') end_date FROM cases a LEFT JOIN second b USING (entity, week_start)", longs="cases iso_year iso_week"),
    query("upsert_keep_last", lambda s, d: P.upsert_keep_last(*both(s, d), ["entity", "week_start"]), "SELECT entity, week_start, coalesce(b.cases, a.cases) cases FROM cases a LEFT JOIN second b USING (entity, week_start)", longs="cases"),
    query("newer_than_watermark", lambda s, d: P.newer_than_watermark(fx.cases(s, d), fx.second_source(s, d).where(week_no() < 300)), f"SELECT * FROM cases WHERE week_start > (SELECT max(week_start) FROM second WHERE {WEEK_NO} < 300)"),
    query("reconcile_sources", lambda s, d: P.reconcile_sources(*both(s, d)), "SELECT *, CASE WHEN n = 0 THEN 'NO OVERLAP' WHEN within_rate >= 0.95 THEN 'PASS' ELSE 'FAIL' END verdict FROM (SELECT count(*) n, avg((abs_diff = 0)::INT::DOUBLE) exact_rate, avg((rel_diff <= 0.05)::INT::DOUBLE) within_rate, max(abs_diff) max_diff FROM diffs)", "exact_rate within_rate", "n max_diff", DIFFS),
    query("reconcile_worst", lambda s, d: P.reconcile_worst(*both(s, d)), "SELECT * FROM diffs ORDER BY abs_diff DESC, entity, week_start LIMIT 5", "rel_diff", "cases_a cases_b abs_diff", DIFFS),
    query("totals_self_check", lambda s, d: P.totals_self_check(stated(s, d)), "SELECT *, rel_diff <= 0.02 ok FROM checks", "stated_total rel_diff", ctes=STATED),
    query("totals_verdict", lambda s, d: P.totals_verdict(P.totals_self_check(stated(s, d))), "SELECT *, n_ok::DOUBLE / nullif(n_checked, 0) pass_rate, CASE WHEN n_checked = 0 THEN 'EMPTY' WHEN n_ok = n_checked THEN 'PASS' WHEN n_ok > 0 THEN 'PARTIAL' ELSE 'FAIL' END verdict FROM (SELECT count(rel_diff) n_checked, count(*) FILTER (rel_diff <= 0.02) n_ok FROM checks)", "pass_rate", "n_checked n_ok", STATED),
    query("situation_table", lambda s, d: P.situation_table(fx.cases(s, d), fx.meta(s, d).where("entity % 5 <> 0")), "SELECT entity, week_start, cases, prev_week, cases - prev_week \"change\", (cases - prev_week)::DOUBLE / greatest(prev_week, CASE WHEN prev_week IS NULL THEN NULL ELSE 1 END) * 100 change_pct, coalesce(m.population, 0) population, cases::DOUBLE / greatest(coalesce(m.population, 0), 1) * 1e5 inc100k FROM (SELECT *, lag(cases) OVER (PARTITION BY entity ORDER BY week_start) prev_week FROM cases) LEFT JOIN (SELECT entity, population FROM meta WHERE entity % 5 <> 0) m USING (entity) WHERE week_start = (SELECT max(week_start) FROM cases)", "change_pct inc100k", "prev_week change population"),
    query("situation_history", lambda s, d: P.situation_history(fx.cases(s, d), 52), "SELECT * FROM cases WHERE week_start > (SELECT max(week_start) FROM cases) - INTERVAL 364 DAY"),
    query("freshness_stats", freshness, f"SELECT *, max(latest_week) OVER () overall_latest, datediff('day', latest_week, DATE '2001-12-01') age_days, datediff('day', latest_week, DATE '2001-12-01') > 28 stale FROM (SELECT 'first' \"source\", max(week_start) latest_week, count(*) n_rows FROM cases UNION ALL SELECT 'second', max(week_start), count(*) FROM second WHERE {WEEK_NO} < 300)", longs="n_rows age_days"),
    query("dedup_key", lambda s, d: P.dedup_key(fx.table(s, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber"), ["l_suppkey", "day"], [F.col("l_orderkey"), F.col("l_linenumber")]), "SELECT l_suppkey, l_shipdate::DATE \"day\", l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate::DATE ORDER BY l_orderkey, l_linenumber) = 1", longs="l_linenumber"),
    query("panel_integrity", lambda s, d: P.panel_integrity(fx.panel(s, d)), "SELECT count(*) n_rows, count(*) FILTER (step = 7) clean_steps, count(*) FILTER (step = 14) gaps_14, count(*) FILTER (step NOT IN (0, 7)) other_steps, count(*) FILTER (step = 0) duplicate_keys, string_agg(DISTINCT (isodow(week_start) - 1)::VARCHAR, ',') weekdays FROM (SELECT week_start, datediff('day', lag(week_start) OVER (PARTITION BY entity ORDER BY week_start), week_start) step FROM panel)"),
    query("distinct_counts", lambda s, d: P.distinct_counts(fx.hot_panel(s, d), "hot"), "SELECT count(DISTINCT week_start) n_weeks, count(DISTINCT entity) n_entities, sum(hot) positives, avg(hot) prevalence FROM hp", "prevalence", "positives"),
    query("union_folds", lambda s, d: P.union_folds({y: fx.panel(s, d).where(f"yr = {y}").select("entity", "week_start", "cases") for y in (1997, 1998, 1999)}), "SELECT entity, week_start, cases, yr fold FROM panel WHERE yr BETWEEN 1997 AND 1999", longs="fold"),
    query("schema_intersection", lambda s, d: fx.panel(s, d).select(*P.schema_intersection(fx.panel(s, d), fx.weekly(s, d), ["c_mean", "a_sum", "entity", "week_start", "inc"])), "SELECT a_sum, c_mean, entity, week_start FROM panel", "a_sum c_mean"),
]
