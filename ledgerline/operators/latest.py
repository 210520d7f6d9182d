"""Orders that don't depend on how rows came in, and what wins by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def document_key(source_rel: Column, source_path: Column, document_id: Column) -> Column:
    """Order of documents: received ones after the others, then by the parts of the path, then by id."""
    split = lambda c: F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    rel = F.coalesce(source_rel, F.lit("")) != ""
    parts = F.when(rel, split(source_rel)).otherwise(F.filter(F.split(F.coalesce(source_path, F.lit("")), "/"), lambda p: p != ""))
    return F.struct((rel & (F.get(parts, F.lit(0)) == "intake")).cast("int").alias("received"), parts.alias("parts"), document_id.alias("document_id"))


def page_key(document: Column, page_no: Column) -> Column:
    return F.struct(document.alias("document"), page_no.alias("page_no"))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the row that comes last in ``order``, which must end in something unique; nulls come first. One
    partial aggregation, so a hot group shuffles one row a task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*by).agg(F.max_by(row, F.struct(*order)).alias("row"))
    return best.select("row.*")


def effective_reviews(reviews: DataFrame) -> DataFrame:
    """The review of each field that counts: the latest, at equal times the one further on in the log."""
    return latest(reviews, ["field_id"], ["reviewed_at", "seq"])


def effective_decisions(decisions: DataFrame) -> DataFrame:
    """For each target the date, whether it is discarded, whether it is kept: in each group of kinds the last counts."""
    group = F.when(F.col("kind").isin("discard", "restore"), "discard").otherwise(F.col("kind"))
    last = latest(decisions.withColumn("kind_group", group), ["target", "kind_group"], ["seq"])
    return last.groupBy("target").agg(
        F.max(F.when(F.col("kind") == "date", F.col("value"))).alias("date"),
        F.coalesce(F.max(F.when(F.col("kind_group") == "discard", (F.col("kind") == "discard").cast("int"))), F.lit(0)).alias("discarded"),
        F.coalesce(F.max(F.when(F.col("kind") == "keep", 1)), F.lit(0)).alias("keep"),
    )


def apply_reviews(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fields with the effective reviews on top; what the machine read never changes."""
    r = effective_reviews(reviews).select("field_id", F.col("verdict").alias("_verdict"), F.col("value").alias("_value"), F.col("reviewer").alias("_by"), F.col("reviewed_at").alias("_at"))
    j = fields.join(r, "field_id", "left")
    v = F.col("_verdict")
    new = {
        "value_final": F.when(v == "value", F.col("_value")).when(v == "empty", F.lit("")).otherwise(F.col("value_final")),
        "has_value": F.when(v == "value", 1).when(v == "empty", 0).otherwise(F.col("has_value")),
        "review_status": F.when(v.isin("value", "empty"), "reviewed").when(v.isNotNull(), "pending").otherwise(F.col("review_status")),
        "reviewed_by": F.when(v.isNotNull(), F.col("_by")).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(v.isNotNull(), F.col("_at")).otherwise(F.col("reviewed_at")),
    }
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in fields.columns])


def rank_in(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in one order over all of them. Rows are range-partitioned and sorted, and get the
    rows of the partitions before theirs added; those counts, one for each partition, are all that is gathered."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    rows, _ = materialise(spread.withColumn("_part", part).withColumn("_in", F.col("_at") - F.shiftleft(part, 33)).drop("_at"), "places")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition
    return rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")


def mode(df: DataFrame, by: list[str], value: str, seen: Column) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that seen first."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("seen"))
    # the largest count, then the smallest place: max_by over (n, -place) needs numbers, so two steps
    most = n.groupBy(*by).agg(F.max("n").alias("n"))
    return n.join(most, [*by, "n"]).groupBy(*by).agg(F.min_by(value, "seen").alias(value), F.first("n").alias("n"))
