"""Several sources for one value, the strongest of which counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date

#: Strongest first.
SOURCES = ["review", "decision", "page_label", "document_label", "filename", "machine"]


def resolve(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``candidates``: the keys, source, value. The strongest source present gives the value. A review that says empty
    (value null) is present: it blocks weaker sources. Elsewhere a null or blank value is no candidate."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    value = F.when(F.trim("value") != "", F.trim("value"))
    there = candidates.withColumn("value", value).withColumn("rank", rank).where("rank > 0 AND (value IS NOT NULL OR source = 'review')")
    best = there.groupBy(*by).agg(F.min_by(F.struct("value", "source"), F.struct("rank", "value")).alias("best"))
    source = F.when(F.col("best.source").isin("page_label", "document_label"), "label").otherwise(F.col("best.source"))
    return best.select(*by, F.col("best.value").alias("value"), source.alias("source"))


def machine_candidates(reads: DataFrame, by: list[str], key: str = "meta_key") -> DataFrame:
    """What machines read counts only if it was accepted, and never for dates and their parts."""
    ok = (F.col("machine_status") == "auto") & ~F.col(key).isin("date", "date.month", "date.day")
    return reads.where(ok).select(*by, F.lit("machine").alias("source"), F.col("machine_value").alias("value"))


def check(human: Column, human_there: Column, machine: Column, status: Column) -> Column:
    """The machine's reading against people's value."""
    same = F.when(machine.eqNullSafe(human), "match").otherwise("mismatch")
    return F.when(status.isNull() | ~human_there, "none").when(status.isin("auto", "unlisted"), same).otherwise("unread")


def page_date(page_decision: Column, document_decision: Column, page_label: Column, document_label: Column, file_name: Column) -> Column:
    """(value, source) of a page's date. Labels count as they are, calendar day or not."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    decided, label = F.coalesce(some(page_decision), some(document_decision)), F.coalesce(some(page_label), some(document_label))
    value = F.coalesce(decided, label, file_name)
    return F.struct(value.alias("value"), F.when(decided.isNotNull(), "decision").when(label.isNotNull(), "label").when(file_name.isNotNull(), "filename").alias("source"))


def document_date(decision: Column, label: Column, file_name: Column) -> Column:
    """(value, source) of a document's date; only days of the calendar count."""
    d, lab, n = iso_date(decision), iso_date(label), iso_date(file_name)
    return F.struct(F.coalesce(d, lab, n).alias("value"), F.when(d.isNotNull(), "decision").when(lab.isNotNull(), "label").when(n.isNotNull(), "filename").alias("source"))


def date_check(parts: DataFrame) -> DataFrame:
    """Month and day as read (page_id, human, machine, status of each part) against the page's date."""
    auto = F.col("status") == "auto"
    wrong = F.max((auto & ~F.col("machine").eqNullSafe(F.col("human"))).cast("int"))
    result = F.when(F.max(F.col("human").isNull().cast("int")) == 1, "none").when(wrong == 1, "mismatch").when(F.min(F.coalesce(auto, F.lit(False)).cast("int")) == 1, "match").otherwise("unread")
    return parts.where("status IS NOT NULL").groupBy("page_id").agg(result.alias("check_result"))


def fallback(left: DataFrame, first: DataFrame, second: DataFrame, first_on: list[str], second_on: list[str], value: str) -> DataFrame:
    """Left rows with a value by the first key, else by the second. Whether the first key is found decides, not whether
    its value is null."""
    a = first.select(*first_on, F.col(value).alias("_a"), F.lit(True).alias("_hit"))
    b = second.select(*second_on, F.col(value).alias("_b"))
    j = left.join(a, first_on, "left").join(b, second_on, "left")
    return j.withColumn(value, F.when(F.col("_hit"), F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b", "_hit")
