"""Captions and table rows as reports print them."""

from datetime import date

import pytest

from panelyard.sources import readers as R

CAPTIONS = [
    ("3rd - 9th July 2023", date(2023, 7, 3), date(2023, 7, 9)),
    ("29th Jan - 04th Feb 2025", date(2025, 1, 29), date(2025, 2, 4)),
    ("Issue 12 (18th - 24th March 2024)", date(2024, 3, 18), date(2024, 3, 24)),
    ("28 Sept. — 4 Oct. 2024", date(2024, 9, 28), date(2024, 10, 4)),
    ("28Dec–3Jan 2025", date(2024, 12, 28), date(2025, 1, 3)),
    ("1ST-7TH MARCH 2024", date(2024, 3, 1), date(2024, 3, 7)),
    ("30 December 2023 - 5 January 2024", date(2023, 12, 30), date(2024, 1, 5)),
    ("31st - 35th June 2024", None, None), ("10th - 16th Ju 2026", None, None), ("10th - 16th Maybe 2026", None, None), ("no date", None, None), (None, None, None),
]


def test_captions(spark):
    df = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(CAPTIONS)], "k int, caption string")
    got = {x.k: (x.week_start, x.week_end) for x in R.parse_caption_weeks(df, "caption").collect()}
    assert [got[i] for i in range(len(CAPTIONS))] == [c[1:] for c in CAPTIONS]


def test_rows_inside_lines(spark):
    text = "as told by phone Peru 11 12 40 35 900 1,234 and\nx Chad* 3 1 7 Nil 20 51*\nsaudi   arabia 1 2 3 4 5 6\nKSA 9 9 9 9 9 9\nPeru 1 1 1 1 1 1\nCuba 1 2 3 4 5 6 7\nXCuba 1 2 3 4 5 6\nMali 1 2 3\nCuba 1 2 3 4 5 6th"
    names = {"Peru": "Peru", "Chad": "Chad", "Saudi Arabia": "Saudi Arabia", "KSA": "Saudi Arabia", "Cuba": "Cuba", "Mali": "Mali"}
    df = spark.createDataFrame([(1, text), (2, "Peru 1 2 3 4 5 6"), (3, None)], "k int, text string")
    got = {(x.k, x.name): (x.prev_week, x.cases, x.cumulative) for x in R.parse_table_rows(df, "k", "text", names, 3).collect()}
    assert got == {(1, "Peru"): (40, 35, 1234), (1, "Chad"): (7, 0, 51), (1, "Saudi Arabia"): (3, 4, 6)}


@pytest.mark.parametrize(("name", "number"), [("SEPT", 9), ("may", 5), ("Ju", None), ("jun", 6), ("x", None)])
def test_month_number(spark, name, number):
    from pyspark.sql import functions as F

    assert spark.range(1).select(R.month_number(F.lit(name))).first()[0] == number
