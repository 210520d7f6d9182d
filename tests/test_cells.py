import itertools

from pyspark.sql import functions as F

from ledgerline.operators import cells, export, latest, precedence, usage
from ledgerline.operators.report import near_tie

FIELD = "page_id string, role string, region string, row_no int, x0 int, row_key string, field_name string, kind string, format string, has_value_raw int, has_value int, value_final string, value_raw string, review_status string, status_raw string, field_id string, row_subtotal boolean"


def field(page, role, name, value, status="auto", fmt="reading", row=0, key="k", has=None, kind="handwritten_number", region=None, sub=False):
    has = int(value not in (None, "")) if has is None else has
    return (page, role, region or role or "fields", row, 0, key, name, kind, fmt, has, has, value, value, status, status, f"{page}:{role}:{name}:{row}", sub)


def rows(spark, data):
    return {r.page_id: r for r in usage.usage_rows(spark.createDataFrame(data, FIELD)).collect()}


def test_reading_kinds_and_hours(spark):
    pages = {
        "meter": ([("start", "10.0"), ("end", "18.5")], "meter", 8.5, "meter"),
        "total": ([("start", None), ("end", None), ("total", "7.5")], "meter", 7.5, "total"),
        "clock": ([("start", "20:00"), ("end", "04:00")], "clock", 8.0, "clock"),
        "mixed": ([("start", "10.0"), ("end", "18:00")], "mixed", None, None),
        "empty": ([("start", None), ("end", None)], "empty", None, None),
        "pending": ([("start", "10.0"), ("end", "18.5", "pending")], "pending", None, None),
        "odd": ([("start", "abc"), ("end", "18.5")], "pending", None, None),
        "clock_total": ([("start", "08:00"), ("end", "17:00"), ("total", "8")], "clock", 8.0, "total"),
        "unknown_total": ([("start", None), ("end", None), ("total", None, "pending")], "pending", None, None),
        "half": ([("start", "5"), ("end", None)], "meter", None, None),
    }
    data = [field(p, "meter", *c) for p, (cs, *_) in pages.items() for c in cs]
    got = rows(spark, data)
    assert {p: (got[p].reading_kind, got[p].hours, got[p].hours_basis) for p in pages} == {p: tuple(x) for p, (_, *x) in pages.items()}
    assert got["pending"].review_status == "pending" and got["meter"].shifts is None and got["meter"].signed is None


def test_shifts_activities_signature(spark):
    data = [
        field("a", "shifts", "time", "20:00~09:00", fmt="time_range", key="night"), field("a", "shifts", "time", "09:00~10:00", fmt="time_range", key="day", row=1),
        field("a", "activities", "work", "x", fmt=None, row=0), field("a", "activities", "note", "y", fmt=None, row=0), field("a", "activities", "work", "z", fmt=None, row=2, sub=True), field("a", None, "sign", "", kind="signature", has=1, fmt=None),
        field("b", "shifts", "time", "08:00~17:00", fmt="time_range"), field("b", "shifts", "time", None, "pending", fmt="time_range", row=1, has=1),
        field("c", "shifts", "one", "08:00~09:00", fmt="time_range"), field("c", "shifts", "two", "10:00~11:00", fmt="time_range"), field("c", "meter", "start", None), field("c", "meter", "end", None),
        field("d", "shifts", "time", None, fmt="time_range"),
    ]
    got = rows(spark, data)
    assert (got["a"].reading_kind, got["a"].shift_minutes, got["a"].hours, got["a"].hours_basis, got["a"].activity_rows, got["a"].signed) == ("none", 840, 14.0, "shifts", 1, 1)
    assert got["a"].shifts == {"night": "20:00~09:00", "day": "09:00~10:00"}
    assert (got["b"].shift_minutes, got["b"].hours, got["b"].hours_basis, got["b"].review_status) == (None, None, None, "pending")
    assert got["c"].shifts == {"k/one": "08:00~09:00", "k/two": "10:00~11:00"} and got["c"].hours == 2.0 and got["c"].reading_kind == "empty"
    assert (got["d"].shifts, got["d"].shift_minutes, got["d"].hours_basis) == ({}, None, None)


def test_page_gate(spark):
    cases = {
        "ok": ([("start", "100"), ("end", "108"), ("total", "8.0")], None),
        "pending": ([("start", "100"), ("end", None, "pending")], "pending"),
        "blank": ([("start", None), ("end", None)], None),
        "incomplete": ([("start", "100"), ("end", None)], "incomplete"),
        "mixed": ([("start", "100"), ("end", "08:00")], "mixed"),
        "range": ([("start", "100"), ("end", "130")], "range"),
        "total": ([("start", "100"), ("end", "108"), ("total", "7")], "total"),
        "clock_like": ([("start", "8.0"), ("end", "17.0")], "clock_like"),
        "clock": ([("start", "08:00"), ("end", "17:00"), ("total", "9")], None),
        "clock_total": ([("start", "08:00"), ("end", "17:00"), ("total", "8")], "total"),
    }
    data = [field(p, "meter", *c) for p, (cs, _) in cases.items() for c in cs]
    data += [field("s1", "shifts", "a", "08:00~17:00", fmt="time_range"), field("s2", "shifts", "a", "08:00~07:00", fmt="time_range"), field("s2", "shifts", "b", "08:00~17:00", fmt="time_range"), field("s3", "shifts", "a", "x", fmt="time_range")]
    want = {p: w for p, (_, w) in cases.items()} | {"s1": None, "s2": "shift_day", "s3": "shift_pending"}
    got = cells.page_gate(spark.createDataFrame(data, FIELD)).collect()
    for r in got:
        if want[r.page_id] and r.has_value_raw and r.reason is None:
            assert r.review_status == "pending"  # waited before
        elif want[r.page_id] and r.has_value_raw:
            assert (r.reason, r.review_status, r.status_raw, r.value_final) == (want[r.page_id], "pending", "pending", None)
        else:
            assert r.reason is None
    assert {r.page_id for r in got if r.reason} == {p for p, w in want.items() if w}


def test_acceptance_rules(spark):
    df = spark.createDataFrame([("value", "7", 0.9), ("value", "7", 0.1), ("value", "70", 0.9), ("value", "x", 0.9), ("empty", "", 0.9), ("empty", "", 0.1), ("reject", "?", 0.9), (None, "7", 0.9), (None, "?", 0.9)], "a string, t string, c double")
    s = cells.number_status(F.col("a"), F.col("t"), F.col("c"), F.lit(0.5), F.lit(60))
    assert [tuple(r.s) for r in df.coalesce(1).select(s.alias("s")).collect()] == [(1, "auto"), (1, "pending"), (1, "pending"), (1, "pending"), (0, "auto"), (1, "pending"), (1, "pending"), (1, "auto"), (1, "pending")]
    df = spark.createDataFrame([("reading", "value", "0123.5", 0.9), ("reading", "value", "08.00", 0.9), ("time", "value", "8", 0.9), ("time", "value", "99", 0.9), ("time", "empty", "", 0.9), ("time", "reject", "?", 0.9), ("decimal", None, "1.0", 0.9), ("decimal", "value", "1.0", 0.2)], "f string, a string, t string, c double")
    s = cells.format_status(F.col("f"), F.col("a"), F.col("t"), F.col("c"), F.lit(0.5), F.lit(""))
    assert [tuple(r.s) for r in df.coalesce(1).select(s.alias("s")).collect()] == [(1, "auto", "123.5"), (1, "pending", None), (1, "auto", "08:00"), (1, "pending", None), (0, "auto", ""), (1, "pending", None), (1, "auto", "1.0"), (1, "pending", None)]


def test_worst_state(spark):
    data = [(n, s) for n, states in enumerate(itertools.combinations_with_replacement(["illegible", "pending", "empty", "value"], 3)) for s in states]
    got = {r.n: r.w for r in spark.createDataFrame(data, "n int, s string").groupBy("n").agg(cells.worst(F.col("s")).alias("w")).collect()}
    for n, states in enumerate(itertools.combinations_with_replacement(["illegible", "pending", "empty", "value"], 3)):
        assert got[n] == ("illegible" if "illegible" in states else "pending" if "pending" in states else "empty" if set(states) == {"empty"} else "value")


def test_inspection_last_page_wins_and_bare_findings_wait(spark):
    c = lambda day, eq, page, cell, has, final, order, status="auto": (day, eq, page, cell, has, final, status, f"{page}:{cell}", order)
    data = [
        c("d", "e1", "p1", "yes", 1, None, 1), c("d", "e1", "p1", "no", 0, None, 1), c("d", "e1", "p1", "remark", 1, "leak", 1),
        c("d", "e1", "p2", "yes", 0, None, 2), c("d", "e1", "p2", "no", 1, None, 2), c("d", "e1", "p2", "remark", 0, "", 2),
        c("d", "e2", "p1", "yes", 1, None, 1), c("d", "e2", "p1", "no", 0, None, 1), c("d", "e2", "p1", "remark", 0, "", 1),
        c("d", "e3", "p1", "yes", 0, None, 1), c("d", "e3", "p1", "no", 0, None, 1, "reviewed"), c("d", "e3", "p1", "remark", 0, "", 1),
        c("d", "e4", "p1", "yes", 1, None, 1),
    ]
    got = {r.equipment_id: r for r in usage.inspection_rows(spark.createDataFrame(data, "work_date string, equipment_id string, page_id string, cell string, has_value int, value_final string, review_status string, field_id string, o int"), "o").collect()}
    assert {e: (r.page_id, r.abnormal, r.review_status) for e, r in got.items()} == {"e1": ("p2", 0, "auto"), "e2": ("p1", 1, "pending"), "e3": ("p1", None, "reviewed")}


def test_reviews_latest_then_place_in_log(spark):
    fields = spark.createDataFrame([("f1", "5", 1, "pending", None, None), ("f2", "6", 1, "auto", None, None), ("f3", "7", 1, "auto", None, None), ("f4", None, 1, "pending", None, None)], "field_id string, value_final string, has_value int, review_status string, reviewed_by string, reviewed_at string")
    reviews = [("f1", "value", "8", "kim", "2025-01-01", 1), ("f1", "value", "9", "lee", "2025-01-01", 2), ("f2", "empty", None, "kim", "2025-01-02", 3), ("f2", "value", "1", "kim", "2025-01-01", 4), ("f3", "illegible", None, "kim", "2025-01-01", 5), ("gone", "value", "1", "kim", "2025-01-01", 6)]
    r = spark.createDataFrame(reviews, "field_id string, verdict string, value string, reviewer string, reviewed_at string, seq long")
    got = {x.field_id: tuple(x)[1:5] for x in latest.apply_reviews(fields, r).collect()}
    assert got == {"f1": ("9", 1, "reviewed", "lee"), "f2": ("", 0, "reviewed", "kim"), "f3": ("7", 1, "pending", "kim"), "f4": (None, 1, "pending", None)}
    twice = latest.apply_reviews(latest.apply_reviews(fields, r), r)
    assert {x.field_id: tuple(x)[1:5] for x in twice.collect()} == got


def test_decisions(spark):
    d = [("t", "date", "2025-01-01", 1), ("t", "date", "2025-02-02", 4), ("t", "discard", None, 2), ("t", "restore", None, 3), ("u", "restore", None, 1), ("u", "discard", None, 2), ("v", "keep", None, 1)]
    got = {r.target: (r.date, r.discarded, r["keep"]) for r in latest.effective_decisions(spark.createDataFrame(d, "target string, kind string, value string, seq long")).collect()}
    assert got == {"t": ("2025-02-02", 0, 0), "u": (None, 1, 0), "v": (None, 0, 1)}


def test_precedence(spark):
    c = [("a", "machine", "m"), ("a", "document_label", "d"), ("a", "page_label", "p"), ("b", "review", None), ("b", "page_label", "p"), ("c", "machine", "m"), ("c", "filename", " "), ("d", "page_label", None), ("e", "review", "r"), ("e", "decision", "x")]
    got = {r.k: (r.value, r.source) for r in precedence.resolve(spark.createDataFrame(c, "k string, source string, value string"), ["k"]).collect()}
    assert got == {"a": ("p", "label"), "b": (None, "review"), "c": ("m", "machine"), "e": ("r", "review")}


def test_dates_by_precedence(spark):
    rows_ = [(None, "2025-01-02", "odd", None, "2025-09-09"), (None, None, None, "odd", "2025-09-09"), (None, None, None, None, "2025-13-09"), ("2025-01-01", "2025-01-02", "x", "y", "z")]
    df = spark.createDataFrame(rows_, "pd string, dd string, pl string, dl string, fn string").coalesce(1)
    c = F.col
    assert [tuple(r.x) for r in df.select(precedence.page_date(c("pd"), c("dd"), c("pl"), c("dl"), c("fn")).alias("x")).collect()] == [("2025-01-02", "decision"), ("odd", "label"), ("2025-13-09", "filename"), ("2025-01-01", "decision")]
    assert [tuple(r.x) for r in df.select(precedence.document_date(c("dd"), c("dl"), c("fn")).alias("x")).collect()] == [("2025-01-02", "decision"), ("2025-09-09", "filename"), (None, None), ("2025-01-02", "decision")]


def test_fallback_goes_by_presence(spark):
    left = spark.createDataFrame([("s1", "d1"), ("s2", "d1"), ("s3", "d9")], "s string, d string")
    a, b = spark.createDataFrame([("s1", None)], "s string, text string"), spark.createDataFrame([("d1", "by date")], "d string, text string")
    assert {r.s: r.text for r in precedence.fallback(left, a, b, ["s"], ["d"], "text").collect()} == {"s1": None, "s2": "by date", "s3": None}


def test_near_tie_variant_and_sheet_names(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 1.5},), ({"a": 1.0, "b": None},), ({"a": 1.0, "b": 3.0},), (None,)], "m map<string,double>").coalesce(1)
    assert [r.x for r in df.select(near_tie(F.col("m")).alias("x")).collect()] == [True, False, False, False]
    v = spark.createDataFrame([("p", "a", True, 2.0, 90), ("p", "b", True, 2.4, 95), ("p", "c", False, 0.1, 99), ("q", "b", False, 9.0, 5), ("q", "a", False, 9.1, 5)], "page_id string, name string, ok boolean, grid_err double, inliers int")
    assert {r.page_id: r.name for r in usage.choose_variant(v).collect()} == {"p": "b", "q": "a"}
    assert export.sheet_names(["a/b", "a_b", "x" * 40, "x" * 40, ""]) == ["a_b", "a_b~2", "x" * 31, "x" * 29 + "~2", "_"]
