import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, formats, ids, stats


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*exprs).collect()]


FORMAT_CASES = [
    ("integer", "007", "7"), ("integer", "1 2", "12"), ("integer", "１２", "12"), ("integer", "-1", None), ("integer", "", None), ("integer", "٣", None), ("integer", "0", "0"),
    ("decimal", "01234.50", "1234.50"), ("decimal", "5", "5"), ("decimal", "5.", None), ("decimal", "００５．１", "5.1"), ("decimal", "0.5", "0.5"),
    ("time", "8:00", "08:00"), ("time", "08:00", "08:00"), ("time", "0800", "08:00"), ("time", "800", "08:00"), ("time", "8", "08:00"), ("time", "08.00", "08:00"), ("time", "24:00", "24:00"), ("time", "24:01", None), ("time", "8:60", None), ("time", "12345", None),
    ("time_range", "8-17", "08:00~17:00"), ("time_range", "08:00～17:30", "08:00~17:30"), ("time_range", "8-", None), ("time_range", "8~9~10", None),
    ("reading", "1234.5", "1234.5"), ("reading", "8:00", "08:00"), ("reading", "08.00", "8.00"), ("reading", "800", "800"), ("reading", "25:00", None),
    (None, "  a b ", "a b"), (None, None, ""), ("integer", None, None), ("other", "1", None),
]


def test_formats(spark):
    got = values(spark, [(f, t) for f, t, _ in FORMAT_CASES], "f string, t string", formats.normalize(F.col("f"), F.col("t")).alias("x"))
    assert [x for (x,) in got] == [x for _, _, x in FORMAT_CASES]


def test_clock_helpers(spark):
    rows = [("08.00",), ("8.75",), ("24.00",), ("24.30",), ("8:00",), (None,)]
    assert [x for (x,) in values(spark, rows, "t string", formats.dotted_clock(F.col("t")).alias("x"))] == ["08:00", None, "24:00", None, None, None]
    rows = [("20:00~09:00",), ("08:00~17:00",), ("08:00",), (None,), ("08:00~08:00",)]
    assert [x for (x,) in values(spark, rows, "t string", formats.range_minutes(F.col("t")).alias("x"))] == [780, 540, None, None, 0]
    rows = [("reading", "08.00", "08:00"), ("reading", "8.00", "8.00"), ("time", "8", "08:00"), ("integer", "", ""), ("integer", "x", "1"), ("integer", None, None), ("decimal", "08.00", "08:00")]
    assert [x for (x,) in values(spark, rows, "f string, w string, v string", formats.same_value(F.col("f"), F.col("w"), F.col("v")).alias("x"))] == [True, True, True, True, False, True, False]


def test_spellings(spark):
    rows = [("time", "08:00"), ("time", "08:30"), ("reading", "08:00"), ("reading", "12.5"), ("time_range", "08:00~17:00"), ("integer", "7"), ("time", ""), ("time", "odd")]
    got = [x for (x,) in values(spark, rows, "f string, v string", formats.spellings(F.col("f"), F.col("v")).alias("x"))]
    assert got[0] == ["08:00", "8:00", "08.00", "8.00", "0800", "800", "08", "8"]
    assert got[1] == ["08:30", "8:30", "08.30", "8.30", "0830", "830"]
    assert got[2] == ["08:00", "8:00", "08.00", "8.00"]
    assert got[3] == ["12.5"] and got[5] == ["7"] and got[6] == [""] and got[7] == ["odd"]
    assert got[4][0] == "08:00~17:00" and "8-17" in got[4] and len(got[4]) == len(set(got[4])) <= 128


DATE_CASES = [
    ("2025-03-26", "2025-04-01", "2025-03-26"), ("25.03.26", "2025-04-01", "2025-03-26"), ("250326", "2025-04-01", "2025-03-26"), ("20250326", "2025-04-01", "2025-03-26"),
    ("0326", "2025-04-01", "2025-03-26"), ("0326", "2025-03-25", "2024-03-26"), ("3/26", "2025-04-01", "2025-03-26"), ("0229", "2025-04-01", "2024-02-29"), ("13-40", "2025-04-01", None),
    ("2025-02-30", "2025-04-01", None), ("2025-03.26", "2025-04-01", None), ("soon", "2025-04-01", None), (None, "2025-04-01", None), (" 2025/3/6 ", "2025-04-01", "2025-03-06"), ("0230", "2025-04-01", None),
]


def test_dates(spark):
    got = values(spark, [(t, date.fromisoformat(r)) for t, r, _ in DATE_CASES], "t string, r date", dates.parse_date(F.col("t"), F.col("r")).alias("x"))
    assert [x for (x,) in got] == [x for *_, x in DATE_CASES]
    rows = [("2025-03-26",), ("2025-3-26",), ("2025-02-29",), (None,), (" 2025-03-26",)]
    assert [x for (x,) in values(spark, rows, "t string", dates.iso_date(F.col("t")).alias("x"))] == ["2025-03-26", None, None, None, "2025-03-26"]
    rows = [("2025-03-01", "2025-03-01"), ("2025-03-01", "2025-03-02"), ("2025-03-01", "2025-03-05"), ("x", "2025-03-05"), ("2025-03-05", "2025-03-01")]
    assert [x for (x,) in values(spark, rows, "a string, b string", dates.days_between(F.col("a"), F.col("b")).alias("x"))] == [0, 0, 3, None, 0]
    rows = [("scan_250326_2.pdf",), ("no date",)]
    assert [x for (x,) in values(spark, rows, "n string", dates.date_from_name(F.col("n"), r"_(\d\d)(\d\d)(\d\d)_").alias("x"))] == ["2025-03-26", None]
    rows = [("2025-04-02", date(2025, 4, 1)), ("2025-02-01", date(2025, 4, 1)), ("2025-03-26", date(2025, 4, 1))]
    assert [x for (x,) in values(spark, rows, "d string, r date", dates.date_warning(F.col("d"), F.col("r")).alias("x"))] == ["future", "far", None]


def test_ids(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["a", "장비 7", "", "x" * 200]
    assert [x for (x,) in values(spark, [(n,) for n in names], "n string", ids.uuid5(space, F.col("n")).alias("x"))] == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]
    rows = [("id1", "n"), (None, "n"), ("", None)]
    assert [x for (x,) in values(spark, rows, "i string, n string", ids.equipment_ref(F.col("i"), F.col("n")).alias("x"))] == ["id:id1", "name:n", None]
    rows = [(None, 1), ("", 1), ("1", None), ("11", 1), ("1", 11)]
    got = [x for (x,) in values(spark, rows, "a string, b long", ids.fingerprint(F.col("a"), F.col("b")).alias("x"))]
    assert len(set(got)) == len(got)
    rows = [("abc-p12",), ("abc",)]
    assert [tuple(x) for (x,) in values(spark, rows, "t string", ids.page_parts(F.col("t")).alias("x"))] == [("abc", 12), ("abc", None)]


def test_stats(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = values(spark, [(0, 0), (0, 100), (50, 100), (100, 100)], "k long, n long", F.round(low, 4).alias("l"), F.round(high, 4).alias("h"))
    assert got == [(0.0, 1.0), (0.0, 0.037), (0.4038, 0.5962), (0.963, 1.0)]
    assert stats.zero_error_sample(0.01) == 381
    rows = [("ab", "ab"), ("", ""), ("a", ""), ("a  b", " a b "), ("누유", "누"), (None, "ab")]
    assert [x for (x,) in values(spark, rows, "p string, t string", stats.cer(F.col("p"), F.col("t")).alias("x"))] == [0, 0, 1, 0, 1, pytest.approx(1)]
