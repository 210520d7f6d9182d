"""From observed and recognised cells to field rows: what is accepted, what waits for a reviewer, what a cell's value is.

Recognition is an input: text, answer (value, empty, reject or null), confidence, threshold, backend, candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from .continuity import DAY_HOURS, TOLERANCE

#: Ink shares and blob areas from which a cell counts as written.
TEXT_INK, HAUL_INK, BLOB_AREA = 0.008, 0.006, 40
CLOCK_MAX_HOUR = 24


def presence(area: Column, ink: Column, least: float = TEXT_INK) -> Column:
    return (F.coalesce(area, F.lit(0)) >= BLOB_AREA) | (F.coalesce(ink, F.lit(0.0)) >= least)


def number_status(answer: Column, text: Column, confidence: Column, threshold: Column, most: Column) -> Column:
    """(has, status) of an integer cell: sure and in range is accepted, sure and empty is accepted as empty."""
    sure = F.coalesce(confidence >= threshold, F.lit(False))
    fits = text.rlike("^[0-9]+$") & (most.isNull() | (text.try_cast("decimal(38,0)") <= most))
    empty = F.coalesce(answer == "empty", F.lit(False))
    ok = F.when(answer.isNull(), sure & text.rlike("^[0-9]+$")).otherwise(F.coalesce((answer == "value") & fits & sure, F.lit(False)))
    has = F.when(empty & sure, 0).otherwise(1)
    return F.struct(has.alias("has_value"), F.when(F.coalesce(ok, F.lit(False)) | (empty & sure), "auto").otherwise("pending").alias("status"))


def format_status(form: Column, answer: Column, text: Column, confidence: Column, threshold: Column, empty_final: Column) -> Column:
    """(has, status, final) of a decimal, time, range or reading cell. A dotted time in a reading always waits, and what
    waits has no final value."""
    sure = F.coalesce(confidence >= threshold, F.lit(False))
    empty = F.coalesce(answer == "empty", F.lit(False)) & sure
    dotted = (form == "reading") & fmt.dotted_clock(text).isNotNull()
    canonical = fmt.normalize(form, text)
    value = (answer.isNull() | (answer == "value")) & sure & ~dotted & canonical.isNotNull()
    return F.struct(
        F.when(empty, 0).otherwise(1).alias("has_value"),
        F.when(empty | value, "auto").otherwise("pending").alias("status"),
        F.when(empty, empty_final).when(value, canonical).alias("value_final"),
    )


def machine_final(fields: DataFrame, empty_final: str | None = None) -> Column:
    """What the machine alone would have as the final value, to reset a field before reviews go on it again."""
    is_format = F.col("format").isNotNull() & (F.col("format") != "integer") & (F.col("region") != "fields")
    final = F.when(F.col("status_raw") == "pending", F.lit(None)).when(F.col("has_value_raw") != 0, fmt.normalize(F.col("format"), F.col("value_raw"))).otherwise(F.lit(empty_final))
    return F.when(is_format, final).otherwise(F.col("value_raw"))


def state(form: Column, has: Column, final: Column, status: Column) -> Column:
    """(kind, value): empty, unknown, or a value in canonical form. A waiting cell without a value, or of a format, is
    unknown whatever the machine saw."""
    blank = F.coalesce(final, F.lit("")) == ""
    formatted = F.coalesce(form != "integer", F.lit(False))
    unknown = (status == "pending") & (blank | formatted)
    kind = F.when(unknown, "unknown").when(F.coalesce(has, F.lit(0)) == 0, "empty").when(blank, "unknown").otherwise("value")
    return F.struct(kind.alias("kind"), F.when(kind == "value", fmt.try_normalize(form, final)).alias("value"))


def cell_int(has: Column, final: Column, status: Column) -> Column:
    """The integer of a cell: blank is 0, waiting or unreadable is null."""
    blank = F.coalesce(final, F.lit("")) == ""
    return F.when((status == "pending") & blank, F.lit(None)).when(F.coalesce(has, F.lit(0)) == 0, 0).otherwise(fmt.as_int(final))


def meter_slot(field_name: Column, row_key: Column) -> Column:
    """start, end or total, from the column's name, else the row's key."""
    named = lambda c: F.when(c.isin("start", "end", "total"), c)
    return F.coalesce(named(field_name), named(row_key))


def meter_value(form: Column, value: Column) -> Column:
    """(kind, number, clock) of a canonical meter cell; null if it isn't one."""
    kind = F.when(form == "time", "clock").when(form == "decimal", "meter").otherwise(fmt.reading_kind(value))
    n, m = fmt.as_number(value), fmt.minutes(value)
    return F.when((kind == "meter") & n.isNotNull(), F.struct(kind.alias("kind"), n.alias("number"), F.lit(None).cast("string").alias("clock"))).when((kind == "clock") & m.isNotNull(), F.struct(kind.alias("kind"), F.lit(None).cast("double").alias("number"), value.alias("clock")))


def meter_gate(start: Column, end: Column, total: Column, pending: Column, n_values: Column, has_total: Column) -> Column:
    """Why a meter table may not be accepted by machine, or null. start, end, total: meter_value() of the cells."""
    s, e, t = start["number"], end["number"], total["number"]
    span = F.round(e - s, 4)
    bad_meter = has_total & (total.isNull() | (total["kind"] != "meter") | (F.abs(F.round(t - (e - s), 4)) > TOLERANCE))
    bad_clock = has_total & (total.isNull() | (total["kind"] != "meter") | (F.abs(F.round(t - fmt.span_minutes(start["clock"], end["clock"]) / 60, 4)) > TOLERANCE))
    return (
        F.when(pending, "pending")
        .when(n_values == 0, F.lit(None))
        .when(start.isNull() | end.isNull(), "incomplete")
        .when(start["kind"] != end["kind"], "mixed")
        .when((start["kind"] == "meter") & ~span.between(0, DAY_HOURS), "range")
        .when(F.when(start["kind"] == "meter", F.coalesce(bad_meter, F.lit(False))).otherwise(F.coalesce(bad_clock, F.lit(False))), "total")
        .when((start["kind"] == "meter") & (s <= CLOCK_MAX_HOUR) & (e <= CLOCK_MAX_HOUR), "clock_like")
    )


def page_gate(cells: DataFrame) -> DataFrame:
    """Machine rows of meter and shift tables (page_id, region, role, field_id, field_name, row_key, format,
    has_value_raw, value_final, review_status, status_raw) to the same rows where a table that doesn't pass has its
    accepted values put back to waiting; ``reason`` says why."""
    slot = meter_slot(F.col("field_name"), F.col("row_key"))
    has = F.coalesce(F.col("has_value_raw"), F.lit(0)) != 0
    filled = F.coalesce(F.col("value_final"), F.lit("")) != ""
    mv = F.when(has & filled, meter_value(F.col("format"), F.col("value_final")))
    pick = lambda name: F.max(F.when(has & (slot == name), mv)).alias(name)
    mins = fmt.range_minutes(F.col("value_final"))
    g = cells.groupBy("page_id", "region", "role").agg(
        F.max((F.col("review_status") == "pending").cast("int")).alias("p"), F.count_if(has).alias("n"), F.count_if(has & (slot == "total")).alias("t"),
        pick("start"), pick("end"), pick("total"), F.count_if(has & mins.isNull()).alias("unread"), F.coalesce(F.sum(F.when(has, mins)), F.lit(0)).alias("minutes"),
    )
    meter = meter_gate(F.col("start"), F.col("end"), F.col("total"), F.col("p") == 1, F.col("n"), F.col("t") > 0)
    shift = F.when((F.col("p") == 1) | (F.col("unread") > 0), "shift_pending").when(F.col("minutes") > DAY_HOURS * 60, "shift_day")
    why = g.select("page_id", "region", F.when(F.col("role") == "meter", meter).when(F.col("role") == "shifts", shift).alias("why"))
    down = F.col("why").isNotNull() & (F.col("review_status") == "auto") & has
    j = cells.join(why, ["page_id", "region"], "left")
    new = {"review_status": F.when(down, "pending").otherwise(F.col("review_status")), "status_raw": F.when(down, "pending").otherwise(F.col("status_raw")), "value_final": F.when(~down, F.col("value_final"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in cells.columns], F.when(down, F.col("why")).alias("reason"))


def rollup_status(status: Column) -> Column:
    """Any waiting: pending; any reviewed: reviewed; else auto."""
    n = lambda s: F.max((status == s).cast("int"))
    return F.when(n("pending") == 1, "pending").when(n("reviewed") == 1, "reviewed").otherwise("auto")


def sheet_state(kind: Column, status: Column, reviewed_by: Column, has: Column, final: Column, meta: Column, override: Column) -> Column:
    """What a sheet's cell shows: the first that applies."""
    return (
        F.when(kind.isNull(), "none")
        .when(kind == "printed", "printed")
        .when(meta.isNotNull(), "meta")
        .when(override.isin("empty", "present"), override)
        .when(status == "pending", F.when(F.coalesce(reviewed_by, F.lit("")) != "", "illegible").otherwise("pending"))
        .when(F.coalesce(has, F.lit(0)) == 0, "empty")
        .when(kind == "checkmark", "mark")
        .when(F.coalesce(final, F.lit("")) != "", "value")
        .otherwise("present")
    )


def row_state(status: Column, reviewed_by: Column, has: Column) -> Column:
    """State of the field that a business row came from; a row without one has a value."""
    waiting = F.when(F.coalesce(reviewed_by, F.lit("")) != "", "illegible").otherwise("pending")
    return F.when(status.isNull(), "value").when(status == "pending", waiting).when(F.coalesce(has, F.lit(0)) != 0, "value").otherwise("empty")


def worst(state_col: Column) -> Column:
    """Illegible over pending over value; empty only if all are. An aggregate."""
    any_of = lambda s: F.max((state_col == s).cast("int")) == 1
    return F.when(any_of("illegible"), "illegible").when(any_of("pending"), "pending").when(F.min((state_col == "empty").cast("int")) == 1, "empty").otherwise("value")


def assign_blobs(blobs: DataFrame, boxes: DataFrame, cell_width: Column, least_overlap: float = 0.3, note_span: float = 1.6) -> tuple[DataFrame, DataFrame]:
    """Connected writing (page_id, blob_id, x0, y0, x1, y1, ink) to the cells (page_id, cell_id, box) that it is in.

    A blob hits a cell if they share at least ``least_overlap`` of the smaller one. One much wider than a cell, or that hits
    three cells or more, or is wider than a cell and hits none, is a note across cells and belongs to none; any other belongs
    to the cell that it shares most with, at equal shares the first. Returns ink by cell, and the blobs with ``note``. A
    page has a form's cells and some hundreds of blobs, which meet on the page's id."""
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    c = boxes.select("page_id", "cell_id", *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    side = lambda a: F.greatest(F.lit(0), F.least(F.col(f"{a}1"), F.col(f"c_{a}1")) - F.greatest(F.col(f"{a}0"), F.col(f"c_{a}0")))
    met = blobs.join(c, "page_id").withColumn("shared", side("x") * side("y"))
    hits = met.where((F.col("shared") > 0) & (F.col("shared") >= least_overlap * F.least(area(""), area("c_"))))
    best = hits.groupBy("page_id", "blob_id").agg(F.count(F.lit(1)).alias("hits"), F.min_by("cell_id", F.struct(-F.col("shared"), "cell_id")).alias("cell_id"))
    width = F.col("x1") - F.col("x0")
    j = blobs.join(best, ["page_id", "blob_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    note = (width > note_span * cell_width) | (F.col("hits") >= 3) | ((F.col("hits") == 0) & (width > cell_width))
    j = j.withColumn("note", note).withColumn("cell_id", F.when(~F.col("note"), F.col("cell_id")))
    return j.where("cell_id IS NOT NULL").groupBy("page_id", "cell_id").agg(F.sum("ink").alias("ink")), j.select("page_id", "blob_id", "hits", "note", "cell_id")


def crop_spec(box: tuple[str, str, str, str], pad: int, width: Column, height: Column, scale: Column) -> Column:
    """Where a cell's crop lies in the source image: the box with a margin, scaled from the aligned page to the source's
    resolution and kept within it."""
    x0, y0, x1, y1 = (F.col(b) for b in box)
    low = lambda v: F.greatest(F.lit(0), F.floor((v - pad) * scale)).cast("int")
    high = lambda v, most: F.least(most, F.ceil((v + pad) * scale)).cast("int")
    return F.struct(low(x0).alias("x0"), low(y0).alias("y0"), high(x1, width).alias("x1"), high(y1, height).alias("y1"))


def unused_columns(marks: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """Pairs of tick cells (``by`` and yes, no as found, 1 or 0) with what they say: where nearly all pairs of a page's column
    are empty it wasn't used, and none of them says anything."""
    empty = (F.coalesce("yes", F.lit(0)) == 0) & (F.coalesce("no", F.lit(0)) == 0)
    g = marks.groupBy(*by).agg((F.count_if(empty) >= share * F.count(F.lit(1))).alias("column_unused"))
    says = F.when(F.col("column_unused") | (F.col("yes") == F.col("no")), F.lit(None).cast("int")).otherwise((F.col("yes") > F.col("no")).cast("int"))
    return marks.join(g, by).withColumn("says", says)
