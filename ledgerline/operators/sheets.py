"""What sheets show, as tables: business rows with their state, forms block by block, monthly pivots, summaries.

A cell's state is value, empty, pending or illegible. A value shows only if it is sure; what the machine read of an unsure
one goes into its own column, and rows name their source (file#page) and field. Every sheet is a join of small parts on
their keys; sorting is left to who writes a sheet, by the columns given for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from .latest import document_key, page_key
from .reconcile import poisoned_sum

UNSURE = ("pending", "illegible")
SETTLED = ("first", "unknown")
SHIFTS = ("day", "night")


def matched(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with a table that grows with the pages. Spark takes some columns of compressed files for far smaller than their
    rows are, and would gather them all in the driver to broadcast them; sorted on both sides nothing passes through it."""
    return rows.join(other.hint("merge"), on, how)


def sure(state: Column) -> Column:
    return ~state.isin(*UNSURE)


def shown(value: Column, state: Column) -> Column:
    """A value if it is sure; nothing for an empty or unsure cell."""
    return F.when(state == "value", value)


def worst_of(*states: Column) -> Column:
    """C.worst() of several columns of a row; null ones play no part, and of none the state is value."""
    s = F.filter(F.array(*states), lambda x: x.isNotNull())
    has = lambda name: F.array_contains(s, name)
    return F.when(has("illegible"), "illegible").when(has("pending"), "pending").when((F.size(s) > 0) & F.forall(s, lambda x: x == "empty"), "empty").otherwise("value")


def field_states(fields: DataFrame) -> DataFrame:
    """field_id, state."""
    return fields.select("field_id", C.row_state(F.col("review_status"), F.col("reviewed_by"), F.col("has_value")).alias("state"))


def with_state(rows: DataFrame, field: str, states: DataFrame, name: str) -> DataFrame:
    """Adds the state of a row's field: value without a field, pending for a field that isn't there any more."""
    s = states.select(F.col("field_id").alias(field), F.col("state").alias("_s"))
    return matched(rows, s, field, "left").withColumn(name, F.when(F.col(field).isNull(), "value").otherwise(F.coalesce("_s", F.lit("pending")))).drop("_s")


def tail(state: Column, machine: Column, source: Column, field: Column) -> list[Column]:
    """The columns that end every business row."""
    return [state.alias("state"), F.when(~sure(state) & (F.coalesce(machine.cast("string"), F.lit("")) != ""), machine.cast("string")).alias("machine"), source.alias("source"), field.alias("field_id")]


# --- reading a day's pages -------------------------------------------------------------------------------------------


def day_pages(pages: DataFrame, documents: DataFrame, days: list[str] | None = None) -> DataFrame:
    """Pages with their source, and ``order``, their place among others. ``days`` limits them."""
    p = pages.where(F.col("work_date").isin(*days)) if days is not None else pages
    d = documents.select("document_id", "source_name", "source_rel", "source_path")
    key = page_key(document_key(F.col("source_rel"), F.col("source_path"), F.col("document_id")), F.col("page_no"))
    return matched(p, d, "document_id").withColumn("source", F.concat_ws("#", "source_name", "page_no")).withColumn("order", key).drop("source_rel", "source_path")


def loaded_parts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (fields, meta) of the pages that are loaded."""
    return rows.join(pages.where("status = 'loaded'").select("page_id"), "page_id", "left_semi")


def hidden_values(meta: DataFrame, fields: DataFrame) -> DataFrame:
    """page_id, meta_key of values that a machine accepted and a reviewer then found illegible: sheets don't show them."""
    open_fields = fields.where((F.col("review_status") == "pending") & (F.coalesce("reviewed_by", F.lit("")) != "")).select("field_id")
    return meta.where("source = 'machine'").join(open_fields, "field_id", "left_semi").select("page_id", "meta_key").distinct()


def without_hidden(rows: DataFrame, hidden: DataFrame, columns: list[str], by: str = "page_id") -> DataFrame:
    """Rows whose columns named like a meta key are emptied where their page hides that key."""
    keys = hidden.groupBy(F.col("page_id").alias(by)).agg(F.collect_set("meta_key").alias("_hidden"))
    j = rows.join(keys, by, "left")
    for c in columns:
        j = j.withColumn(c, F.when(~F.coalesce(F.array_contains("_hidden", c), F.lit(False)), F.col(c)))
    return j.drop("_hidden")


def waiting_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """work_date, n: documents in work or asked for again, by each day that they or their pages are of."""
    open_ = documents.where((F.col("status") == "received") | (F.coalesce("work_requested", F.lit(0)) > F.coalesce("work_done", F.lit(0))))
    own = open_.select("document_id", "work_date")
    by_page = pages.select("document_id", "work_date").join(open_.select("document_id"), "document_id", "left_semi")
    return own.unionByName(by_page).where("work_date IS NOT NULL").distinct().groupBy("work_date").agg(F.count(F.lit(1)).alias("n"))


# --- business sheets -------------------------------------------------------------------------------------------------


def haul_state() -> Column:
    return C.row_state(F.col("review_status"), F.col("reviewed_by"), F.col("has_value"))


def _located(rows: DataFrame, field: str, fields: DataFrame, pages: DataFrame) -> DataFrame:
    f = fields.select(F.col("field_id").alias(field), F.col("row_no").alias("at_row"), F.col("x0").alias("at_x"), "reviewed_by")
    return rows.join(f, field, "left").join(pages.select("page_id", "source"), "page_id", "left").withColumn("state", haul_state())


def haul_sheet(haul: DataFrame, fields: DataFrame, pages: DataFrame, hidden: DataFrame, role: str, only_marked: bool = False) -> DataFrame:
    """Rows of one role. The matrix's vehicles and operators are printed heads, so nothing of them is hidden;
    ``only_marked`` leaves empty cells that don't wait out."""
    h = haul.where(F.col("source_role") == role)
    h = h.where("has_value <> 0 OR review_status = 'pending'") if only_marked else h
    h = _located(h, "source_field_id", fields, pages)
    h = without_hidden(h, hidden, ["vehicle_no", "operator"]) if role == "log" else h
    return h.select("work_date", F.lit(role).alias("role"), F.coalesce("slot", F.lit("unresolved")).alias("slot"), "vehicle_no", "operator", "material", "level", "shift", shown(F.col("trips"), F.col("state")).alias("trips"), *tail(F.col("state"), F.col("trips_raw"), F.col("source"), F.col("source_field_id")))


def slot_keys(haul: DataFrame, meta_vehicle: DataFrame) -> DataFrame:
    """Haul rows with the key that the cross-check knows their slot by: for a log page without a slot ``unresolved:`` and
    the page's vehicle (page_id, value), else its own rows' vehicle, else the page."""
    own = haul.where("slot IS NULL").groupBy("page_id").agg(F.min("vehicle_no").alias("_own"))
    j = haul.join(meta_vehicle.select("page_id", F.col("value").alias("_meta"), F.lit(True).alias("_there")), "page_id", "left").join(own, "page_id", "left")
    named = F.when(F.col("_there"), F.col("_meta")).otherwise(F.col("_own"))
    key = F.concat(F.lit("unresolved:"), F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.col("page_id")))
    return j.withColumn("slot_key", F.coalesce("slot", key)).drop("_meta", "_there", "_own")


def crosscheck_sheet(checks: DataFrame, haul: DataFrame, fields: DataFrame, pages: DataFrame, hidden: DataFrame, meta_vehicle: DataFrame) -> DataFrame:
    """Checks with the state of the rows that they compare: a verdict on unsure rows is provisional, and its sums aren't
    shown. A check none of whose rows is found any more is not sure either."""
    key = ["work_date", "slot", "material", "level"]
    h = slot_keys(_located(haul, "source_field_id", fields, pages), meta_vehicle).drop("slot").withColumnRenamed("slot_key", "slot")
    mine = F.col("source_role") == "log"
    hides = hidden.groupBy("page_id").agg(F.collect_set("meta_key").alias("_hidden"))
    h = h.join(hides, "page_id", "left")
    hide = lambda c: F.max((mine & F.coalesce(F.array_contains("_hidden", c), F.lit(False))).cast("int")).alias(f"_hide_{c}")
    g = h.groupBy(*key).agg(C.worst(F.col("state")).alias("rows_state"), F.array_join(F.array_sort(F.collect_set(F.when(mine, F.col("source")))), ", ").alias("source"), hide("vehicle_no"), hide("operator"))
    j = checks.join(g, key, "left")
    lost = F.col("rows_state").isNull() & ((F.coalesce("log_has", F.lit(0)) != 0) | (F.coalesce("matrix_has", F.lit(0)) != 0) | F.col("slot").startswith("unresolved:"))
    state = F.when(lost, "pending").otherwise(F.coalesce("rows_state", F.lit("value")))
    loose, ok = F.col("slot").startswith("unresolved:"), sure(F.col("state"))
    machine = F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("log_trips_raw", "matrix_trips_raw")])
    own = lambda c: F.when(~loose & (F.coalesce(f"_hide_{c}", F.lit(0)) == 0), F.col(c)).alias(c)
    j = j.withColumn("state", state)
    end = tail(F.when(ok, "value").otherwise(F.col("state")), machine, F.coalesce("source", F.lit("")), F.lit(None).cast("string"))
    return j.select(F.col("work_date"), F.when(loose, "unresolved").otherwise(F.col("slot")).alias("shown_slot"), "slot", own("vehicle_no"), own("operator"), "material", "level", F.when(ok, F.col("log_trips")).alias("log_trips"), F.when(ok, F.col("matrix_trips")).alias("matrix_trips"), "status", (~ok).alias("provisional"), *end)


def assignment_sheet(observed: DataFrame, haul: DataFrame, pages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Which vehicle and operator were in a slot, with the log pages that say so."""
    logs = haul.where("source_role = 'log' AND slot IS NOT NULL").select("work_date", "slot", "page_id").distinct()
    hides = hidden.groupBy("page_id").agg(F.collect_set("meta_key").alias("_hidden"))
    g = logs.join(pages.select("page_id", "source"), "page_id", "left").join(hides, "page_id", "left")
    g = g.groupBy("work_date", "slot").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source"), F.array_distinct(F.flatten(F.collect_list("_hidden"))).alias("_hidden"))
    own = lambda c: F.when(~F.coalesce(F.array_contains("_hidden", c), F.lit(False)), F.col(c)).alias(c)
    j = observed.join(g, ["work_date", "slot"], "left")
    return j.select("work_date", "slot", own("vehicle_no"), own("operator"), "header_vehicle_no", "header_operator", "matched_by", (F.col("header_mismatch") != 0).alias("mismatch"), *tail(F.lit("value"), F.lit(None).cast("string"), F.coalesce("source", F.lit("")), F.lit(None).cast("string")))


def usage_sheet(usage: DataFrame, fields: DataFrame, shift_fields: DataFrame, pages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Daily usage: each value by its own field's state, hours by those of what they rest on. ``shift_fields`` are the
    field rows of shift cells."""
    states = field_states(fields)
    u = usage
    for k in ("start", "end", "total"):
        u = with_state(u, f"{k}_field_id", states, f"s_{k}")
    shifts = shift_fields.withColumn("state", haul_state()).groupBy("page_id").agg(C.worst(F.col("state")).alias("s_shifts"))
    u = u.join(shifts, "page_id", "left").join(pages.select("page_id", "source"), "page_id", "left")
    u = without_hidden(u, hidden, ["equipment", "operator"])
    c = F.col
    of_basis = F.when(c("hours_basis").isin("meter", "clock"), worst_of(c("s_start"), c("s_end"))).when(c("hours_basis") == "total", worst_of(c("s_total"), c("s_start"), c("s_end"))).when(c("hours_basis") == "shifts", c("s_shifts"))
    u = u.withColumn("s_hours", F.coalesce(of_basis, F.lit("value")))
    named = [F.when(c(f"{k}_field_id").isNotNull(), c(f"s_{k}")) for k in ("start", "end", "total")]
    raw = [F.when((F.coalesce(f"meter_{k}_raw", F.lit("")) != "") & ~sure(c(f"s_{k}")), F.concat_ws(" ", F.lit(k), f"meter_{k}_raw")) for k in ("start", "end", "total")]
    text = F.array_join(F.transform(F.array_sort(F.map_entries("shifts")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    val = lambda name, state: F.when(sure(c(state)), c(name)).alias(name)
    at_shift = F.coalesce("s_shifts", F.lit("value"))
    return u.select(
        "work_date", "source_form", "equipment", "operator", "reading_kind", val("meter_start", "s_start"), val("meter_end", "s_end"), val("meter_total", "s_total"), val("clock_start", "s_start"), val("clock_end", "s_end"),
        F.when(sure(at_shift), text).alias("shifts"), F.when(sure(at_shift), c("shift_minutes")).alias("shift_minutes"), "activity_rows", "signed", val("hours", "s_hours"), val("hours_basis", "s_hours"),
        *tail(worst_of(*named, c("s_shifts")), F.concat_ws(" / ", *raw), c("source"), F.concat_ws(" ", "start_field_id", "end_field_id", "total_field_id")),
    )


def tally_sheet(tally: DataFrame, fields: DataFrame, pages: DataFrame, hidden: DataFrame, only_marked: bool = False) -> DataFrame:
    t = tally.where("has_value <> 0 OR review_status = 'pending'") if only_marked else tally
    t = without_hidden(_located(t, "source_field_id", fields, pages), hidden, ["equipment"])
    return t.select("work_date", "source_form", "equipment", "item", "place", "column_name", "shift", (F.col("is_subtotal") != 0).alias("subtotal"), shown(F.col("count"), F.col("state")).alias("count"), *tail(F.col("state"), F.col("count_raw"), F.col("source"), F.col("source_field_id")))


def usage_check_sheet(checks: DataFrame, compared: DataFrame, fields: DataFrame, usage: DataFrame, pages: DataFrame, hidden: DataFrame) -> DataFrame:
    """Checks of usage with the state of the cells they compare (handlers.check_cells). Only verdicts that rest on values
    can be provisional: a first record, or one of an unknown machine, is what it is."""
    key = ["page_id", "check_kind", "item"]
    s = with_state(compared, "field_id", field_states(fields), "s").groupBy(*key).agg(C.worst(F.col("s")).alias("_state"), F.count(F.lit(1)).alias("_n"))
    j = checks.join(s, key, "left").join(usage.select("page_id", "equipment"), "page_id", "left").join(pages.select("page_id", "source"), "page_id", "left")
    j = j.join(pages.select(F.col("page_id").alias("other_page_id"), F.col("source").alias("other_source")), "other_page_id", "left")
    j = without_hidden(j, hidden, ["equipment"])
    # a subtotal of which no part is known is not settled
    bare = (F.col("check_kind") == "subtotal") & (F.coalesce("_n", F.lit(0)) < 2)
    j = j.withColumn("state", F.when(bare, "pending").otherwise(F.coalesce("_state", F.lit("pending"))))
    ok = sure(F.col("state"))
    val = lambda c: F.when(F.col("state") == "value", F.col(c)).alias(c)
    return j.select(
        "work_date", "check_kind", "item", "equipment", val("value_a"), val("value_b"), val("diff"), "days_between", "result", (~ok & ~F.col("result").isin(*SETTLED)).alias("provisional"),
        (ok & F.col("result").isin("mismatch", "gap", "overlap")).alias("marked"), "other_source", *tail(F.when(ok, "value").otherwise(F.col("state")), F.lit(None).cast("string"), F.col("source"), F.col("field_a")),
    )


def inspection_sheet(daily: DataFrame, equipment: DataFrame, pages: DataFrame, marks: DataFrame, fields: DataFrame) -> DataFrame:
    """Inspections with machine and page (left joins: a row stays without either). ``marks`` has inspection_id, field_id and
    override ("empty" where the form's handler says the cell counts as empty) of the two mark cells; a finding shows only
    if both are sure."""
    states = field_states(fields)
    m = with_state(marks, "field_id", states, "s").withColumn("s", F.when(F.col("override") == "empty", "empty").otherwise(F.col("s")))
    m = m.groupBy("inspection_id").agg(C.worst(F.col("s")).alias("s_marks"))
    j = matched(daily.join(equipment.select("equipment_id", "hid"), "equipment_id", "left"), pages.select("page_id", "source", "template_name"), "page_id", "left")
    j = matched(j, m, "inspection_id", "left")
    j = with_state(j, "source_field_id", states, "s_remark")
    unknown = F.when(F.col("review_status") == "pending", "pending").otherwise("value")
    j = j.withColumn("s_marks", F.coalesce("s_marks", unknown))
    filled = lambda c: F.when(F.col(c) == "empty", "value").otherwise(F.col(c))
    state = worst_of(filled("s_marks"), filled("s_remark"))
    return j.select("inspection_date", F.coalesce("hid", "equipment_id").alias("machine_id"), "template_name", F.when(sure(F.col("s_marks")), F.col("abnormal")).alias("abnormal"), shown(F.when(F.col("remark") != "", F.col("remark")), F.col("s_remark")).alias("remark"), *tail(state, F.lit(None).cast("string"), F.col("source"), F.col("source_field_id")))


# --- forms -----------------------------------------------------------------------------------------------------------


def form_blocks(pages: DataFrame, layout: DataFrame, fields: DataFrame, meta: DataFrame, hidden: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Each loaded page laid out as its form is: a row for each cell with its place in the block, state and value.

    ``layout``: template, family, region_no, region, row_no, row_key, idx, field_name and meta_key (of fields outside
    tables), from templates.region_cells(). Cells that the page has no field for are there too, without a value; fields
    that the layout doesn't know aren't. ``overrides`` (field_id, override) say how a handler wants a cell shown."""
    p = pages.where("status = 'loaded'").select("page_id", "work_date", "source", F.col("template_name").alias("template"))
    cell = p.join(layout, "template").withColumn("field_id", F.concat_ws(":", "page_id", "region", "field_name", F.col("row_no").cast("string")))
    f = fields.select("field_id", "kind", "format", "review_status", "reviewed_by", "has_value", "value_final")
    cell = cell.join(f, "field_id", "left")
    known = meta.join(hidden, ["page_id", "meta_key"], "left_anti").select("page_id", "meta_key", F.col("value").alias("meta_value"))
    cell = cell.join(known, ["page_id", "meta_key"], "left")
    cell = cell.join(overrides, "field_id", "left") if overrides is not None else cell.withColumn("override", F.lit(None).cast("string"))
    c = F.col
    state = C.sheet_state(c("kind"), c("review_status"), c("reviewed_by"), c("has_value"), c("value_final"), c("meta_value"), c("override"))
    cell = cell.withColumn("state", state)
    value = F.when(c("state") == "meta", c("meta_value")).when(c("state") == "value", c("value_final"))
    return cell.select("work_date", "family", "page_id", "source", "template", "region_no", "region", "row_no", "row_key", "idx", "field_name", "state", value.alias("value"))


def pending_cells(blocks: DataFrame) -> DataFrame:
    """work_date, family, n: cells that wait, by day and family; families without any are there with 0."""
    return blocks.groupBy("work_date", "family").agg(F.count_if(F.col("state").isin(*UNSURE)).alias("n"))


# --- the month's haul table ------------------------------------------------------------------------------------------


def haul_blocks(haul: DataFrame, pages: DataFrame) -> DataFrame:
    """Log rows with their block: the slot, or for a day's pages without one their number in the pages' order. ``haul`` has
    reviewed_by."""
    loose = haul.where("source_role = 'log' AND slot IS NULL").select("work_date", "page_id").distinct()
    loose = matched(loose, pages.select("page_id", "source", "order"), "page_id", "left")
    nth = loose.withColumn("k", F.row_number().over(Window.partitionBy("work_date").orderBy(F.col("order").asc_nulls_last(), "page_id")))
    j = matched(haul.where("source_role = 'log'"), nth.select("work_date", "page_id", "k", "source"), ["work_date", "page_id"], "left")
    return j.withColumn("block", F.when(F.col("slot").isNull(), F.concat(F.lit("unresolved "), F.col("k").cast("string"))).otherwise(F.col("slot"))).withColumn("item", F.concat_ws("|", "material", "level"))


def haul_table(haul: DataFrame, pages: DataFrame, days: DataFrame, checks: DataFrame) -> DataFrame:
    """A row for each day, shift and block: ``cells`` maps an item to its mark and trips, ``total`` is there only if every
    cell is sure and none overlaps. Every slot of the month has a row on every day: where it has no log page the block says
    so (no_document), or that it can't be known because the day has pages without a slot (unknown). Cells whose settled
    cross-check is a mismatch are flagged. A month has some dozens of slots and shifts, so the grid is small."""
    b = haul_blocks(haul, pages).withColumn("state", haul_state())
    mark = F.when(F.count(F.lit(1)) > 1, "overlap").otherwise(F.first(F.when(F.col("state").isin(*UNSURE), F.col("state")).when(F.col("state") == "empty", "empty").when(F.col("trips").isNull(), "present").otherwise("value")))
    g = b.groupBy("work_date", "block", "shift", "item").agg(mark.alias("mark"), F.first("trips").alias("trips"), F.min("slot").alias("slot"), F.min("source").alias("source"))
    unsure = haul.withColumn("item", F.concat_ws("|", "material", "level")).where(haul_state().isin(*UNSURE)).select("work_date", "slot", "item").distinct()
    wrong = checks.where("status = 'mismatch'").select("work_date", "slot", F.concat_ws("|", "material", "level").alias("item")).join(unsure, ["work_date", "slot", "item"], "left_anti").withColumn("mismatch", F.lit(True))
    g = g.join(wrong, ["work_date", "slot", "item"], "left")
    cell = F.struct("item", F.struct("mark", F.when(F.col("mark") == "value", F.col("trips")).alias("trips"), F.coalesce("mismatch", F.lit(False)).alias("mismatch")).alias("cell"))
    settled = F.count_if(F.col("mark").isin("overlap", "present", *UNSURE)) == 0
    lines = g.groupBy("work_date", "block", "shift").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("cells"), F.when(settled, F.coalesce(F.sum(F.when(F.col("mark") == "value", F.col("trips"))), F.lit(0))).alias("total"), F.min("source").alias("source"))
    slots = haul.where("slot IS NOT NULL").select(F.col("slot").alias("block")).distinct()
    shifts = haul.where("source_role = 'log'").select("shift").distinct()
    every = days.select("work_date").distinct().withColumn("_", F.lit(1)).join(slots.withColumn("_", F.lit(1)), "_").join(shifts.withColumn("_", F.lit(1)), "_").drop("_")
    there = b.where("slot IS NOT NULL").select("work_date", F.col("slot").alias("block")).distinct().withColumn("_there", F.lit(True))
    loose = b.where("slot IS NULL").select("work_date").distinct().withColumn("_loose", F.lit(True))
    blocks = every.unionByName(lines.select("work_date", "block", "shift")).distinct()
    same = (blocks["work_date"] == lines["work_date"]) & (blocks["block"] == lines["block"]) & blocks["shift"].eqNullSafe(lines["shift"])
    j = blocks.join(lines, same, "left").select(blocks["work_date"], blocks["block"], blocks["shift"], "cells", "total", "source")
    j = j.join(there, ["work_date", "block"], "left").join(loose, "work_date", "left")
    is_slot = ~F.col("block").startswith("unresolved ")
    missing = is_slot & F.col("_there").isNull()
    return j.select("work_date", "block", "shift", F.when(missing & F.col("_loose"), "unknown").when(missing, "no_document").otherwise("log").alias("line"), "cells", "total", "source")


def settled_total(value: Column, has: Column) -> Column:
    """A sum across blocks that is given only if all its parts are known."""
    return poisoned_sum(value, has)


# --- summaries -------------------------------------------------------------------------------------------------------


def summary(days: Callable[[Column], Column], pages: DataFrame, families: DataFrame, pending: DataFrame, haul_checks: DataFrame, usage_checks: DataFrame, waiting: DataFrame) -> DataFrame:
    """(period, section, key, n) for days, or with another ``days`` for months: pages by status and in all, loaded pages and
    waiting cells by family, cross-checks, checks of usage, documents in work."""
    period = days(F.col("work_date")).alias("period")

    def part(df: DataFrame, section: str, key: Column, n: Column) -> DataFrame:
        return df.where("work_date IS NOT NULL").groupBy(period, key.alias("key")).agg(n.alias("n")).select("period", F.lit(section).alias("section"), "key", F.col("n").cast("long").alias("n"))

    one = F.count(F.lit(1))
    named = pages.where("status = 'loaded'").join(families.select(F.col("template").alias("template_name"), "family"), "template_name", "left")
    parts = [
        part(pages, "pages", F.col("status"), one),
        part(pages, "pages", F.lit("all"), one),
        part(named, "forms", F.coalesce("family", "template_name"), one),
        part(pending, "pending", F.col("family"), F.sum("n")),
        part(pending, "pending", F.lit("all"), F.sum("n")),
        part(haul_checks, "crosscheck", F.col("status"), one),
        part(usage_checks, "usage", F.concat_ws(".", "check_kind", "result"), one),
        part(waiting, "waiting", F.lit("documents"), F.sum("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def month_days(pages: DataFrame, pending: DataFrame, haul: DataFrame, haul_checks: DataFrame, usage_checks: DataFrame) -> DataFrame:
    """A month's table of days: pages, failed ones, waiting cells, matches, mismatches, missing sides, wrong usage, pages
    without a slot."""
    c = F.col
    p = pages.groupBy("work_date").agg(F.count(F.lit(1)).alias("pages"), F.count_if(c("status") != "loaded").alias("not_loaded"))
    w = pending.groupBy("work_date").agg(F.sum("n").alias("pending"))
    x = haul_checks.groupBy("work_date").agg(F.count_if(c("status") == "match").alias("match"), F.count_if(c("status") == "mismatch").alias("mismatch"), F.count_if(c("status").isin("missing_log", "missing_matrix")).alias("missing"))
    u = usage_checks.where(c("result").isin("mismatch", "gap", "overlap")).groupBy("work_date").agg(F.count(F.lit(1)).alias("usage_wrong"))
    n = haul.where("source_role = 'log' AND slot IS NULL").groupBy("work_date").agg(F.count_distinct("page_id").alias("unresolved"))
    out = p
    for other in (w, x, u, n):
        out = out.join(other, "work_date", "left")
    return out.na.fill(0)
