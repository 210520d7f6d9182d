"""Forms as data: regions' cells, validity by day, families and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Bounds are included, null ones are open; a row without a day is valid under all."""
    return day.isNull() | ((start.isNull() | (start <= day)) & (end.isNull() | (day <= end)))


def templates_for(pages: DataFrame, templates: DataFrame, day: str = "work_date") -> DataFrame:
    """Pages with the templates valid on their day. Templates are a catalog of forms, some dozens: broadcast."""
    return pages.join(F.broadcast(templates), valid_on(F.col(day), F.col("valid_from"), F.col("valid_to")))


def family_of(family: Column, template: Column) -> Column:
    return F.coalesce(family, template)


def overlaps(templates: DataFrame) -> DataFrame:
    """Templates of one family, not marked as concurrent, that are valid on a common day."""
    a, b = templates.alias("a"), templates.alias("b")
    c = F.col
    low = F.greatest(F.coalesce(c("a.valid_from"), F.lit("")), F.coalesce(c("b.valid_from"), F.lit("")))
    high = F.least(F.coalesce(c("a.valid_to"), F.lit("9999")), F.coalesce(c("b.valid_to"), F.lit("9999")))
    return a.join(b, (c("a.family") == c("b.family")) & (c("a.template") < c("b.template")) & ~(c("a.concurrent") & c("b.concurrent")) & (low <= high)).select("a.family", c("a.template").alias("one"), c("b.template").alias("other"))


def region_cells(regions: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """The cells of each region: its columns by its rows, with boxes from the grid lines (ys, xs)."""
    c = columns.select("template", "region", F.col("idx"), F.col("name").alias("field_name"), "kind", "format")
    r = rows.select("template", "region", F.col("row").alias("row_no"), F.col("key").alias("row_key"))
    j = regions.select("template", "region", "header_rows", "ys", "xs").join(c, ["template", "region"]).join(r, ["template", "region"])
    y = F.col("row_no") + F.col("header_rows")
    return j.select("template", "region", "row_no", "row_key", "field_name", "kind", "format", F.get("xs", F.col("idx")).alias("x0"), F.get("xs", F.col("idx") + 1).alias("x1"), F.get("ys", y).alias("y0"), F.get("ys", y + 1).alias("y1"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: what a rule check reports."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_equipment_row(key: Column, model: Column, registration: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return some(key) & (some(model) | some(F.regexp_replace(registration, "^-+|-+$", "")))


def route(cells: DataFrame, by_format: dict[str, str], by_kind: dict[str, str], default: str) -> DataFrame:
    """Which recogniser reads a cell: by its format, else by its kind, else the default."""
    pick = lambda d, c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in sorted(d.items())], F.lit(None).cast("string")) if d else F.lit(None).cast("string")
    return cells.withColumn("recognizer", F.coalesce(pick(by_format, "format"), pick(by_kind, "kind"), F.lit(default)))
