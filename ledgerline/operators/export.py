"""Sheets as tables: haul by day and slot, daily and monthly summaries, hidden values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSURE = ("pending", "illegible")


def ordered_names(names: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Names with their place: the wanted ones first and in that order, then the others by name."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(name)) if wanted else F.lit(0)
    return names.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(len(wanted) + 1), name)))


def haul_cells(haul: DataFrame, states: Column) -> DataFrame:
    """Log rows to a cell for each day, shift, slot and material|level: several rows are an overlap and aren't summed."""
    h = haul.where("source_role = 'log'").withColumn("state", states).withColumn("item", F.concat_ws("|", "material", "level"))
    g = h.groupBy("work_date", "shift", "slot", "item").agg(F.count(F.lit(1)).alias("n"), F.first("state").alias("state"), F.first("trips").alias("trips"))
    mark = F.when(F.col("n") > 1, "overlap").when(F.col("state").isin(*UNSURE), F.col("state")).when(F.col("state") == "empty", "empty").when(F.col("trips").isNull(), "present").otherwise("value")
    return g.select("work_date", "shift", "slot", "item", mark.alias("mark"), F.when(mark == "value", F.col("trips")).alias("trips"))


def haul_lines(cells: DataFrame) -> DataFrame:
    """A line's total, only if every cell of it is sure."""
    bad = F.count_if(F.col("mark").isin("overlap", "present", *UNSURE))
    return cells.groupBy("work_date", "shift", "slot").agg(F.when(bad == 0, F.coalesce(F.sum("trips"), F.lit(0))).alias("total"))


def provisional(checks: DataFrame, haul: DataFrame, unsure: Column) -> DataFrame:
    """Checks with whether any row they compare isn't settled."""
    key = ["work_date", "slot", "material", "level"]
    open_keys = haul.where(unsure).select(*key).distinct().withColumn("provisional", F.lit(True))
    return checks.join(open_keys, key, "left").withColumn("provisional", F.coalesce("provisional", F.lit(False)))


def hidden_meta(meta: DataFrame, fields: DataFrame) -> DataFrame:
    """Meta values for sheets: a machine's value doesn't show if a reviewer found its field illegible."""
    f = fields.select("field_id", "review_status", "reviewed_by")
    j = meta.join(f, "field_id", "left")
    hide = (F.col("source") == "machine") & (F.col("review_status") == "pending") & (F.coalesce("reviewed_by", F.lit("")) != "")
    return j.withColumn("shown", F.when(~F.coalesce(hide, F.lit(False)), F.col("value"))).drop("review_status", "reviewed_by")


def calendar(first: str, last: str, spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("work_date"))


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: without the seven characters it refuses, at most 31 long, and all different."""
    out: list[str] = []
    for n in names:
        base = "".join("_" if c in "[]:*?/\\" else c for c in n).strip("'")[:31] or "_"
        name, i = base, 2
        while name.lower() in {x.lower() for x in out}:
            tail = f"~{i}"
            name, i = base[: 31 - len(tail)] + tail, i + 1
        out.append(name)
    return out
