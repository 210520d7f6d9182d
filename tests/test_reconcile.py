import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import continuity, reconcile
from ledgerline.operators.duplicates import hold_repeats

HAUL = "haul_id string, work_date string, source_role string, page_id string, slot string, vehicle_no string, operator string, material string, level string, shift string, has_value_raw int, has_value int, trips int, trips_raw int"


def haul(i, role, page, slot=None, vehicle=None, operator=None, level="L0", shift="day", has=1, trips=None, raw=None, has_raw=None, day="2025-03-01", material="ore"):
    return (f"h{i:03d}", day, role, page, slot, vehicle, operator, material, level, shift, has if has_raw is None else has_raw, has, trips, raw)


def check(spark, rows, **more):
    x, obs = reconcile.crosscheck(spark.createDataFrame(rows, HAUL), **more)
    return {(r.slot, r.level): r for r in x.collect()}, {r.slot: r for r in obs.collect()}


def test_presence_mismatch(spark):
    got, obs = check(spark, [haul(1, "log", "p1", operator="kim", level="L0"), haul(2, "log", "p1", operator="kim", level="L1", has=0), haul(3, "matrix", "m", "1", operator="kim", level="L1"), haul(4, "matrix", "m", "1", operator="kim", level="L0", has=0)])
    assert {k: r.status for k, r in got.items()} == {("1", "L0"): "mismatch", ("1", "L1"): "mismatch"}
    assert obs["1"].matched_by == "operator" and obs["1"].header_mismatch == 0


@pytest.mark.parametrize("night,matrix,status", [(2, 7, "match"), (3, 4, "mismatch")])
def test_shifts_add_up(spark, night, matrix, status):
    got, _ = check(spark, [haul(1, "log", "p1", operator="kim", trips=5), haul(2, "log", "p1", operator="kim", shift="night", trips=night), haul(3, "matrix", "m", "1", operator="kim", trips=matrix)])
    assert got[("1", "L0")].status == status and got[("1", "L0")].log_trips == 5 + night


def test_missing_sides(spark):
    got, obs = check(spark, [haul(1, "matrix", "m", "1", operator="kim", trips=4), haul(2, "log", "p9", vehicle="77", operator="lee", trips=1)])
    assert got[("1", "L0")].status == "missing_log" and got[("1", "L0")].log_has is None
    assert got[("unresolved:77", "L0")].status == "missing_matrix" and not obs


def test_log_without_the_key_counts_as_absent(spark):
    got, _ = check(spark, [haul(1, "log", "p1", operator="kim", level="L0", trips=1), haul(2, "matrix", "m", "1", operator="kim", level="L1", has=0), haul(3, "matrix", "m", "1", operator="kim", level="L0", trips=1)])
    assert (got[("1", "L1")].status, got[("1", "L1")].log_has) == ("match", 0)


def test_operator_first_then_vehicle(spark):
    rows = [haul(1, "matrix", "m", "1", vehicle="11", operator="kim"), haul(2, "matrix", "m", "2", vehicle="22", operator="lee"), haul(3, "matrix", "m", "3", vehicle="33", operator="park")]
    rows += [haul(4, "log", "p1", vehicle="11", operator="kim"), haul(5, "log", "p2", vehicle="99", operator="lee"), haul(6, "log", "p3", vehicle="33", operator="choi")]
    _, obs = check(spark, rows)
    assert {s: (r.matched_by, r.header_mismatch) for s, r in obs.items()} == {"1": ("operator", 0), "2": ("operator", 1), "3": ("vehicle", 1)}


def test_unknown_poisons_the_sum_on_its_own_layer(spark):
    rows = [haul(1, "log", "p1", operator="kim", trips=2, raw=2), haul(2, "log", "p1", operator="kim", shift="night", trips=None, raw=None, has=1), haul(3, "matrix", "m", "1", operator="kim", trips=4, raw=4)]
    got, _ = check(spark, rows)
    assert got[("1", "L0")].status == "match" and got[("1", "L0")].log_trips is None and got[("1", "L0")].log_trips_raw is None
    rows[1] = haul(2, "log", "p1", operator="kim", shift="night", trips=3, raw=None, has=1, has_raw=0)
    got, _ = check(spark, rows)
    assert (got[("1", "L0")].status, got[("1", "L0")].log_trips, got[("1", "L0")].log_trips_raw) == ("mismatch", 5, 2)


def test_excluded_materials(spark):
    got, _ = check(spark, [haul(1, "matrix", "m", "1", operator="kim", material="water")], exclude=("water",))
    assert not got


def greedy(pages, slots):
    out, taken = {}, set()
    for key, how in (("operator", "operator"), ("vehicle_no", "vehicle")):
        for p in pages:
            if p["page_id"] in out or not p[key]:
                continue
            for s in slots:
                if s["slot"] not in taken and s[key] and s[key] == p[key]:
                    out[p["page_id"]] = (s["slot"], how)
                    taken.add(s["slot"])
                    break
    return out


def test_slots_equal_the_greedy_walk(spark):
    rng = random.Random(1)
    pages, slots, want = [], [], {}
    for day in range(120):
        a = [{"work_date": str(day), "page_id": f"{day}-{i}", "operator": rng.choice([None, "", "a", "b", "c"]), "vehicle_no": rng.choice([None, "1", "2", "3"]), "o": i} for i in range(rng.randrange(7))]
        b = [{"work_date": str(day), "slot": f"{i}", "operator": rng.choice([None, "a", "b", "c"]), "vehicle_no": rng.choice([None, "1", "2", "3"]), "o": i} for i in range(rng.randrange(7))]
        pages += a
        slots += b
        want |= greedy(a, b)
    schema = "work_date string, {0} string, operator string, vehicle_no string, o int"
    p = spark.createDataFrame([tuple(x.values()) for x in pages], schema.format("page_id")).orderBy(F.rand(3))
    s = spark.createDataFrame([tuple(x.values()) for x in slots], schema.format("slot")).orderBy(F.rand(4))
    got = reconcile.assign_slots(p, s, ["work_date"], ["o"], ["o"]).collect()
    assert {r.page_id: (r.slot, r.matched_by) for r in got} == want


RECORDS = "page_id string, ref string, work_date string, source_name string, page_no int, reading_kind string, meter_start double, meter_end double"


def walk(records):
    """Continuity one record at a time."""
    out = {}
    order = lambda r: (r[2] or "", r[6] is None, r[6] or 0.0, r[3], r[4], r[0])
    for r in records:
        page, ref, day, _, _, kind, start, _ = r
        if start is None and kind != "pending":
            continue
        chain = sorted((q for q in records if q[1] == ref and q[2]), key=order)
        if ref is None or start is None or not day or any(q is not r and q[2] == day and q[6] is None and q[5] == "pending" for q in chain):
            out[page] = ("unknown", None, None)
            continue
        prev, blocked = None, False
        for q in reversed(chain[: [q is r for q in chain].index(True)]):
            if q[7] is not None:
                prev = q
                break
            if q[5] == "pending" or q[6] is not None:
                blocked = True
                break
        if blocked:
            out[page] = ("unknown", None, None)
        elif prev is None:
            out[page] = ("first", None, None)
        else:
            d = round(start - prev[7], 4)
            out[page] = ("match" if abs(d) <= 0.05 else "gap" if d > 0 else "overlap", prev[0], d)
    return out


def test_continuity_equals_the_walk(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        kind = rng.choice(["meter", "meter", "meter", "pending", "clock", "empty"])
        start = float(rng.randrange(40)) if kind == "meter" or rng.random() < 0.05 else None
        end = start + rng.choice([0.0, 1.0, 0.04]) if start is not None and rng.random() < 0.8 else None
        rows.append((f"p{i:04d}", rng.choice([None, *[f"id:{k}" for k in range(40)]]), rng.choice([None, "", *[f"2025-03-{k:02d}" for k in range(1, 9)]]), rng.choice("ab"), rng.randrange(3), kind, start, end))
    df = spark.createDataFrame(rows, RECORDS)
    want = walk(rows)
    for shuffled in (df, df.orderBy(F.rand(5)).repartition(5)):
        got = {r.page_id: (r.result, r.other_page_id, r["diff"]) for r in continuity.continuity(shuffled).collect()}
        assert got == want


def test_days_between(spark):
    rows = [("a", "id:1", "2025-03-01", "s", 1, "meter", 1.0, 2.0), ("b", "id:1", "2025-03-05", "s", 1, "meter", 2.0, 3.0), ("c", "id:1", "odd", "s", 1, "meter", 9.0, 9.0)]
    got = {r.page_id: r.days_between for r in continuity.continuity(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {"a": None, "b": 3, "c": None}


def test_totals_and_subtotals(spark):
    u = spark.createDataFrame([("a", "d", 1.0, 9.0, 8.04), ("b", "d", 1.0, 9.0, 7.0), ("c", "d", 1.0, None, 7.0)], "page_id string, work_date string, meter_start double, meter_end double, meter_total double")
    assert {r.page_id: r.result for r in continuity.total_check(u).collect()} == {"a": "match", "b": "mismatch"}
    grid = [(t, "r", row, col, row == 2, col == "sum") for t in ("t",) for row in (0, 1, 2) for col in ("x", "y", "sum")]
    pairs = continuity.subtotal_pairs(spark.createDataFrame(grid, "template string, region string, row_no int, column string, row_subtotal boolean, column_subtotal boolean")).cache()
    assert {(r.row_no, r.column): 0 for r in pairs.collect()}.keys() == {(0, "sum"), (1, "sum"), (2, "sum"), (2, "x"), (2, "y")}
    assert sorted((r.part_row, r.part_column) for r in pairs.collect() if (r.row_no, r.column) == (2, "sum")) == [(2, "x"), (2, "y")]

    def cells(page, numbers):
        return [(page, "t", "r", row, col, f"{page}:{row}:{col}", 0 if n == "" else 1, None if n == "?" else 0 if n == "" else n) for (row, col), n in numbers.items()]

    good = {(0, "x"): 1, (0, "y"): 2, (0, "sum"): 3, (1, "x"): 4, (1, "y"): "", (1, "sum"): 4, (2, "x"): 5, (2, "y"): 2, (2, "sum"): 7}
    rows = cells("p", good) + cells("q", good | {(1, "y"): "?", (0, "sum"): 4, (2, "sum"): ""})
    got = continuity.subtotal_check(spark.createDataFrame(rows, "page_id string, template string, region string, row_no int, column string, field_id string, has_value int, number long"), pairs).collect()
    assert {r.item: r.result for r in got if r.page_id == "p"} == {f"p:{r}:{c}": "match" for r, c in [(0, "sum"), (1, "sum"), (2, "sum"), (2, "x"), (2, "y")]}
    assert {r.item: (r.result, r.value_b) for r in got if r.page_id == "q"} == {"q:0:sum": ("mismatch", 3), "q:1:sum": ("unknown", None), "q:2:x": ("match", 5), "q:2:y": ("unknown", None)}


def test_repeats_are_held_against_kept_pages_only(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        v = [rng.gauss(0, 1) for _ in range(3)] if i % 17 else [0.0, 0.0, 0.0]
        rows.append((rng.choice("ab"), i, f"p{i:03d}", v if i % 23 else [1.0, 2.0]))
    df = spark.createDataFrame(rows, "day string, o int, page_id string, sig array<double>")
    want, kept = {}, {"a": [], "b": []}
    for day, _, page, v in rows:
        n = sum(x * x for x in v) ** 0.5
        best = max(((sum(x * y for x, y in zip(v, w, strict=True)) / n / m, -k, p) for k, (p, w, m) in enumerate(kept[day]) if len(w) == len(v)), default=None) if n else None
        if best and best[0] >= 0.8:
            want[page] = best[2]
        elif n:
            kept[day].append((page, v, n))
    got = {r.page_id: r.duplicate_of for r in hold_repeats(df.orderBy(F.rand(1)), ["day"], "o", "sig").collect()}
    assert got == want and len(want) > 20
