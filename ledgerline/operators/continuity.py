"""Running meters: does each record start where the one before it ended?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between

#: Tolerance of a meter's value in hours, and hours of a day.
TOLERANCE, DAY_HOURS = 0.05, 24
ORDER = ["meter_start", "source_name", "page_no", "page_id"]


def continuity(records: DataFrame) -> DataFrame:
    """A row for each record with a meter's start or a pending one: match, gap, overlap, first or unknown.

    ``records``: page_id, ref, work_date, source_name, page_no, reading_kind, meter_start, meter_end. A record is
    compared with the last one before it on the same machine that has a meter's value. That comparison is unknown if
    the machine, the date or the start is, if the last record before has no known end, or if another record of the
    same day may come first because its start is pending. One shuffle by machine; frames look back only.
    """
    r = records.select("page_id", "ref", "work_date", "source_name", "page_no", "reading_kind", "meter_start", "meter_end")
    dated = F.coalesce(F.col("work_date"), F.lit("")) != ""
    usable = F.col("ref").isNotNull() & dated
    pending = F.col("reading_kind") == "pending"
    # records of no known machine or day have nothing before them; they don't meet in one partition
    chain = Window.partitionBy("ref").orderBy("work_date", F.col("meter_start").isNull(), *ORDER)
    stop = F.when(F.col("meter_end").isNotNull() | pending | F.col("meter_start").isNotNull(), F.struct("page_id", "work_date", "meter_end"))
    prev = F.last(stop, ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    same_day = F.count_if(F.col("meter_start").isNull() & pending).over(Window.partitionBy("ref", "work_date"))
    known = r.where(usable).withColumn("prev", prev).withColumn("unplaced", same_day)
    loose = r.where(~usable).withColumn("prev", F.lit(None).cast(known.schema["prev"].dataType)).withColumn("unplaced", F.lit(0).cast("long"))
    rows = known.unionByName(loose).where(F.col("meter_start").isNotNull() | pending)
    start, end = F.col("meter_start"), F.col("prev.meter_end")
    diff = F.round(start - end, 4)
    blocked = (F.col("unplaced") > 0) | (F.col("prev").isNotNull() & end.isNull())
    result = F.when(~usable | start.isNull() | blocked, "unknown").when(F.col("prev").isNull(), "first").when(F.abs(diff) <= TOLERANCE, "match").when(diff > 0, "gap").otherwise("overlap")
    compared = result.isin("match", "gap", "overlap")
    only = lambda c: F.when(compared, c)
    return rows.select(
        "page_id",
        F.lit("continuity").alias("check_kind"),
        "work_date",
        F.col("ref").alias("equipment_ref"),
        start.alias("value_a"),
        only(end).alias("value_b"),
        only(diff).alias("diff"),
        only(days_between(F.col("prev.work_date"), F.col("work_date"))).alias("days_between"),
        result.alias("result"),
        only(F.col("prev.page_id")).alias("other_page_id"),
    )


def total_check(usage: DataFrame) -> DataFrame:
    """Where start, end and total are known: is the total their difference?"""
    span = F.col("meter_end") - F.col("meter_start")
    diff = F.round(F.col("meter_total") - span, 4)
    rows = usage.where("meter_start IS NOT NULL AND meter_end IS NOT NULL AND meter_total IS NOT NULL")
    return rows.select("page_id", F.lit("total").alias("check_kind"), "work_date", F.col("meter_total").alias("value_a"), F.round(span, 4).alias("value_b"), diff.alias("diff"), F.when(F.abs(diff) <= TOLERANCE, "match").otherwise("mismatch").alias("result"))


def subtotal_pairs(cells: DataFrame) -> DataFrame:
    """Cells of a tally region (template, region, row_no, column, row_subtotal, column_subtotal) to the cells that each
    subtotal adds up: along its row for a subtotal column, down its column for a subtotal row, and along the subtotal
    row for the sum of sums. Regions are as large as a form, so pairs stay few."""
    key = ["template", "region"]
    part = cells.select(*key, F.col("row_no").alias("part_row"), F.col("column").alias("part_column"), F.col("row_subtotal").alias("pr"), F.col("column_subtotal").alias("pc"))
    sums = cells.where("row_subtotal OR column_subtotal")
    along = F.col("column_subtotal") & (F.col("part_row") == F.col("row_no")) & ~F.col("pc")
    down = F.col("row_subtotal") & ~F.col("column_subtotal") & (F.col("part_column") == F.col("column")) & ~F.col("pr")
    return sums.join(part, key).where(along | down).select(*key, "row_no", "column", "part_row", "part_column")


def subtotal_check(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written subtotals against the sums of their parts; unknown if the subtotal or a part is.

    ``cells``: page_id, template, region, row_no, column, field_id, has_value, number (null if unknown, 0 if blank).
    A part without a cell counts as 0."""
    sub = cells.where("has_value <> 0").select("page_id", "template", "region", "row_no", "column", "field_id", F.col("number").alias("got"))
    parts = cells.select("page_id", "template", "region", F.col("row_no").alias("part_row"), F.col("column").alias("part_column"), "number", F.lit(1).alias("there"))
    j = sub.join(pairs, ["template", "region", "row_no", "column"]).join(parts, ["page_id", "template", "region", "part_row", "part_column"], "left")
    g = j.groupBy("page_id", "field_id", "got").agg(F.count_if(F.col("there").isNotNull() & F.col("number").isNull()).alias("unread"), F.coalesce(F.sum("number"), F.lit(0)).alias("sum"))
    known = F.col("got").isNotNull() & (F.col("unread") == 0)
    result = F.when(~known, "unknown").when(F.col("got") == F.col("sum"), "match").otherwise("mismatch")
    return g.select("page_id", F.lit("subtotal").alias("check_kind"), F.col("field_id").alias("item"), F.col("got").alias("value_a"), F.when(known, F.col("sum")).alias("value_b"), F.when(known, F.col("got") - F.col("sum")).alias("diff"), result.alias("result"))
