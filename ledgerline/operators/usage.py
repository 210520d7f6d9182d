"""Business rows from final field rows: daily usage of machines, tallies, inspections, hauls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as fmt
from . import cells as C


def usage_rows(fields: DataFrame) -> DataFrame:
    """A row for each page: kind of reading, meter and clock values, shifts, hours and what they rest on.

    ``fields`` are final rows of handwritten and signature cells with their region's role (meter, shifts, activities or
    null): page_id, role, region, row_no, x0, row_key, field_name, kind, format, has_value, value_final, value_raw,
    review_status, field_id, row_subtotal. Hours come from the meter, else its total, else the clock, else the shifts;
    a basis that is there but unknown ends the search.
    """
    f = fields.withColumn("hand", F.col("kind").startswith("handwritten")).withColumn("s", C.state(F.col("format"), F.col("has_value"), F.col("value_final"), F.col("review_status")))
    is_meter = (F.col("role") == "meter") & F.col("hand")
    slot = F.when(is_meter, C.meter_slot(F.col("field_name"), F.col("row_key")))
    is_shift = (F.col("role") == "shifts") & F.col("hand") & (F.col("format") == "time_range")
    f = f.withColumn("slot", slot).withColumn("mv", F.when(slot.isNotNull() & (F.col("s.kind") == "value"), C.meter_value(F.col("format"), F.col("s.value"))))
    # a value that doesn't fit its format is unknown
    f = f.withColumn("st", F.when(F.col("slot").isNotNull() & (F.col("s.kind") == "value") & F.col("mv").isNull(), "unknown").otherwise(F.col("s.kind")))
    f = f.withColumn("shift_min", F.when(is_shift & (F.col("s.kind") == "value"), fmt.range_minutes(F.col("s.value")))).withColumn("is_shift", F.coalesce(is_shift, F.lit(False)))
    same_key = F.count(F.lit(1)).over(Window.partitionBy("page_id", "is_shift", "row_key"))
    f = f.withColumn("shift_key", F.when(same_key == 1, F.col("row_key")).otherwise(F.concat_ws("/", "row_key", "field_name")))
    of = lambda s, c: F.max(F.when(F.col("slot") == s, c))
    shift = F.col("is_shift")
    known_shift = shift & F.col("shift_min").isNotNull()
    counted = shift | F.col("slot").isNotNull()
    g = f.groupBy("page_id").agg(
        F.max((F.col("role") == "meter").cast("int")).alias("has_meter"),
        *[of(s, F.col("mv.number")).alias(f"m_{s}") for s in ("start", "end", "total")],
        *[of(s, F.col("mv.clock")).alias(f"c_{s}") for s in ("start", "end", "total")],
        *[F.coalesce(of(s, (F.col("st") == "unknown").cast("int")), F.lit(0)).alias(f"u_{s}") for s in ("start", "end", "total")],
        *[of(s, F.when(F.col("value_raw") != "", F.col("value_raw"))).alias(f"meter_{s}_raw") for s in ("start", "end", "total")],
        *[of(s, F.col("field_id")).alias(f"{s}_field_id") for s in ("start", "end", "total")],
        F.max(shift.cast("int")).alias("has_shift"),
        F.count_if(shift & (F.col("s.kind") != "empty")).alias("n_shift"),
        F.count_if(shift & (F.col("s.kind") != "empty") & F.col("shift_min").isNull()).alias("n_shift_unknown"),
        F.sum(F.when(known_shift, F.col("shift_min"))).alias("shift_sum"),
        F.array_sort(F.collect_set(F.when(known_shift, F.struct("shift_key", "s.value")))).alias("shift_list"),
        F.max((F.col("role") == "activities").cast("int")).alias("has_activities"),
        F.count_distinct(F.when((F.col("role") == "activities") & F.col("hand") & (F.col("has_value") != 0) & ~F.coalesce("row_subtotal", F.lit(False)), F.struct("region", "row_no"))).alias("n_activities"),
        F.max(F.when(F.col("kind") == "signature", (F.coalesce("has_value", F.lit(0)) != 0).cast("int"))).alias("signed"),
        C.rollup_status(F.when(counted, F.col("review_status"))).alias("review_status"),
    )
    is_m, is_c = F.coalesce("m_start", "m_end").isNotNull(), F.coalesce("c_start", "c_end").isNotNull()
    unknown = F.greatest("u_start", "u_end", "u_total") == 1
    kind = (
        F.when(F.coalesce("has_meter", F.lit(0)) == 0, "none").when(unknown, "pending").when(is_m & is_c, "mixed").when(is_m, "meter").when(is_c, "clock")
        .when(F.col("m_total").isNotNull(), "meter").when(F.col("c_total").isNotNull(), "clock").otherwise("empty")
    )
    shift_min = F.when((F.col("n_shift_unknown") == 0) & (F.col("n_shift") > 0), F.col("shift_sum"))
    g = g.withColumn("reading_kind", kind).withColumn("shift_minutes", shift_min)
    basis = hours_basis(g)
    hours = F.when(basis == "meter", F.col("m_end") - F.col("m_start")).when(basis == "total", F.col("m_total")).when(basis == "clock", fmt.span_minutes(F.col("c_start"), F.col("c_end")) / 60).when(basis == "shifts", F.col("shift_minutes") / 60)
    return g.select(
        "page_id", "reading_kind", F.col("m_start").alias("meter_start"), F.col("m_end").alias("meter_end"), F.col("m_total").alias("meter_total"),
        F.col("c_start").alias("clock_start"), F.col("c_end").alias("clock_end"), "meter_start_raw", "meter_end_raw", "meter_total_raw",
        F.when(F.col("has_shift") == 1, F.map_from_entries("shift_list")).alias("shifts"), "shift_minutes",
        F.when(F.col("has_activities") == 1, F.col("n_activities")).alias("activity_rows"), "signed", F.round(hours, 4).alias("hours"), basis.alias("hours_basis"),
        "start_field_id", "end_field_id", "total_field_id", "review_status",
    )


def hours_basis(g: DataFrame) -> Column:
    no = F.lit(None).cast("string")
    return (
        F.when(F.col("reading_kind") == "mixed", no)
        .when((F.col("u_start") == 1) | (F.col("u_end") == 1), no)
        .when(F.col("m_start").isNotNull() & F.col("m_end").isNotNull(), "meter")
        .when(F.col("u_total") == 1, no)
        .when(F.col("m_total").isNotNull(), "total")
        .when(F.col("c_start").isNotNull() & F.col("c_end").isNotNull(), "clock")
        .when((F.col("n_shift") > 0) & F.col("shift_minutes").isNotNull(), "shifts")
    )


def tally_rows(fields: DataFrame) -> DataFrame:
    """Rows of tally cells: integer handwritten cells with the row's and column's meaning (item, place, shift)."""
    f = fields.where((F.col("role") == "tally") & (F.col("format") == "integer") & F.col("kind").startswith("handwritten"))
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) != 0).cast("int")
    return f.select(F.col("field_id").alias("tally_id"), "page_id", F.coalesce("item", "row_key").alias("item"), "place", F.col("field_name").alias("column_name"), "shift", (F.coalesce("row_subtotal", F.lit(False)) | F.coalesce("column_subtotal", F.lit(False))).cast("int").alias("is_subtotal"), flag("has_value_raw").alias("has_value_raw"), flag("has_value").alias("has_value"), fmt.as_int(F.col("value_final")).alias("count"), fmt.as_int(F.col("value_raw")).alias("count_raw"), "confidence", "review_status")


def inspection_rows(cells: DataFrame, order: str) -> DataFrame:
    """Check marks and remarks to a row for each day and machine; of several pages the last in ``order`` wins.

    ``cells``: page_id, work_date, equipment_id, cell (yes, no or remark), has_value, value_final, review_status,
    field_id and ``order``. A machine's row needs both marks. An abnormal finding without a remark waits.
    """
    of = lambda cell, c: F.max(F.when(F.col("cell") == cell, c))
    g = cells.groupBy("work_date", "equipment_id", "page_id").agg(
        F.max(order).alias("_o"), *[of(x, F.lit(1)).alias(f"has_{x}") for x in ("yes", "no", "remark")], of("yes", F.col("has_value")).alias("yes"), of("no", F.col("has_value")).alias("no"),
        of("remark", F.col("has_value")).alias("remarked"), of("remark", F.col("value_final")).alias("remark"), of("remark", F.col("field_id")).alias("source_field_id"), C.rollup_status(F.col("review_status")).alias("status"),
    ).where("has_yes = 1 AND has_no = 1")
    abnormal = F.when(F.col("yes") == 1, 1).when(F.col("no") == 1, 0)
    bare = F.col("has_remark").isNull() | ((abnormal == 1) & (F.coalesce("remarked", F.lit(0)) == 0))
    row = F.struct("page_id", abnormal.alias("abnormal"), "remark", "source_field_id", F.when(F.coalesce(bare, F.lit(False)), "pending").otherwise(F.col("status")).alias("review_status"))
    best = g.groupBy("work_date", "equipment_id").agg(F.max_by(row, F.struct("_o", "page_id")).alias("row"))
    return best.select(F.concat_ws(":", "work_date", "equipment_id").alias("inspection_id"), F.col("work_date").alias("inspection_date"), "equipment_id", "row.*", F.lit("scan").alias("entry_source"))


def haul_values(fields: DataFrame) -> DataFrame:
    """Haul rows' values from their fields."""
    flag = lambda c: (F.coalesce(F.col(c), F.lit(0)) != 0).cast("int").alias(c)
    return fields.select(F.col("field_id").alias("haul_id"), "page_id", flag("has_value_raw"), flag("has_value"), fmt.as_int(F.col("value_final")).alias("trips"), fmt.as_int(F.col("value_raw")).alias("trips_raw"), "confidence", "review_status")


def document_status(documents: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Processed documents need review if a field waits or a page failed; other statuses stay."""
    bad = pages.where(F.col("status").isin("unknown_form", "align_failed", "error", "duplicate")).select("document_id")
    waiting = pages.select("document_id", "page_id").join(fields.where("review_status = 'pending'").select("page_id").distinct(), "page_id", "left_semi").select("document_id")
    flagged = bad.unionByName(waiting).distinct().withColumn("flagged", F.lit(True))
    j = documents.join(flagged, "document_id", "left")
    new = F.when(F.col("status").isin("processed", "needs_review"), F.when(F.col("flagged"), "needs_review").otherwise("processed")).otherwise(F.col("status"))
    return j.withColumn("status", new).drop("flagged")


def page_status(known: Column, aligned: Column, ink: Column, handled: Column, duplicate: Column, discarded: Column, error: Column, least_ink: float = 0.0005) -> Column:
    """The status of a page from what was found out about it: the first that applies."""
    return F.when(discarded, "discarded").when(error, "error").when(~known & (ink < least_ink), "blank").when(~known, "unknown_form").when(~aligned, "align_failed").when(~handled, "classified_only").when(duplicate, "duplicate").otherwise("loaded")


def choose_variant(candidates: DataFrame, tie: float = 0.5) -> DataFrame:
    """Of a page's aligned variants (page_id, name, ok, grid_err, inliers) the one to use: of those that passed, if any
    did, within ``tie`` of the least error the one with most inliers, then the first name."""
    w = Window.partitionBy("page_id")
    pool = candidates.withColumn("any_ok", F.max(F.col("ok").cast("int")).over(w)).where((F.col("any_ok") == 0) | F.col("ok"))
    near = pool.withColumn("low", F.min("grid_err").over(w)).where(F.col("grid_err") <= F.col("low") + tie)
    return near.withColumn("n", F.row_number().over(w.orderBy(F.desc("inliers"), "name"))).where("n = 1").select("page_id", "name", "grid_err", "inliers")


def classify(scores: DataFrame, least: int = 60) -> DataFrame:
    """Best family of a page (page_id, family, inliers) and its margin over the second, if it has enough inliers."""
    w = Window.partitionBy("page_id").orderBy(F.desc("inliers"), "family")
    top = scores.withColumn("second", F.lead("inliers").over(w)).withColumn("n", F.row_number().over(w)).where("n = 1")
    margin = F.when(F.coalesce("second", F.lit(0)) > 0, F.col("inliers") / F.col("second"))
    return top.select("page_id", F.when(F.col("inliers") >= least, F.col("family")).alias("family"), "inliers", margin.alias("margin"))
