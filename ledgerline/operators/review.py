"""Reviews and decisions: checked before they are written, with their context, and what they touch; reviewers' queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions.dates import iso_date
from ..functions.ids import joined_id, page_parts
from .diff import row_changes
from .latest import effective_decisions, effective_reviews
from .sampling import queue, stratified

VERDICTS = ("value", "empty", "illegible")
DECISIONS = ("date", "discard", "restore", "keep")


def with_context(reviews: DataFrame, fields: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """New reviews (field_id, verdict, value, reviewer, reviewed_at, note) with the field's place and what the machine had
    read, the value in canonical form, an id, and ``error`` for those that may not be written."""
    place = pages.select("page_id", "template_name", "page_no", "document_id").join(documents.select("document_id", "source_name"), "document_id")
    f = fields.select("field_id", "page_id", "region", "field_name", "row_no", "row_key", F.col("format").alias("_format"), "has_value_raw", "value_raw", "backend", "confidence")
    j = reviews.join(f, "field_id", "left").join(place, "page_id", "left")
    value = F.when(F.col("verdict") == "value", fmt.normalize(F.col("_format"), F.col("value")))
    blank = F.coalesce(fmt.strip(F.col("value")), F.lit("")) == ""
    error = F.when(F.col("page_id").isNull(), "no such field").when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "no such verdict").when((F.col("verdict") == "value") & (blank | value.isNull()), "value doesn't fit")
    source = F.concat_ws("#", "source_name", "page_no")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("|"), F.col("note"))).otherwise("")
    rid = joined_id(F.col("field_id"), F.col("verdict"), value, F.col("reviewer"), F.concat(F.col("reviewed_at"), note))
    machine = F.struct(F.col("has_value_raw").alias("has_value"), "value_raw", "backend", "confidence").alias("machine")
    return j.select(rid.alias("review_id"), "field_id", "verdict", value.alias("value"), "reviewer", "reviewed_at", "note", source.alias("source"), F.col("template_name").alias("template"), "region", "field_name", "row_no", "row_key", machine, error.alias("error"))


def accepted(batch: DataFrame) -> DataFrame:
    """A batch is written as a whole or not at all: its rows if none has an error."""
    # at most one row
    bad = F.broadcast(batch.where("error IS NOT NULL").select(F.lit(True).alias("_bad")).limit(1))
    return batch.join(bad, F.col("_bad"), "left_anti").drop("error")


def check_decisions(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """New decisions (target, kind, value, decided_by, decided_at, note) with document, page, id and error. Targets are
    documents or their pages."""
    part = page_parts(F.col("target"))
    b = batch.withColumn("document_id", part["document_id"]).withColumn("page_no", part["page_no"])
    j = b.join(documents.select("document_id", "n_pages"), "document_id", "left")
    known = documents.select(F.col("document_id"), F.lit(True).alias("_known"))
    j = j.join(known, "document_id", "left")
    error = (
        F.when(F.col("_known").isNull(), "no such document").when(F.col("page_no") > F.col("n_pages"), "no such page").when(~F.coalesce(F.col("kind").isin(*DECISIONS), F.lit(False)), "no such kind")
        .when((F.col("kind") == "date") & iso_date(F.col("value")).isNull(), "not a day").when((F.col("kind") == "keep") & F.col("page_no").isNull(), "only pages are kept")
    )
    did = joined_id(*[F.col(c) for c in ("target", "kind", "value", "decided_by", "decided_at")])
    return j.select(did.alias("decision_id"), "target", "document_id", "page_no", "kind", "value", "decided_by", "decided_at", "note", error.alias("error"))


def touched_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose effective decisions a longer log changes: to be processed again."""
    changed = row_changes(effective_decisions(before), effective_decisions(after), ["target"])
    return changed.select(page_parts(F.col("target"))["document_id"].alias("document_id")).distinct()


def request(documents: DataFrame, touched: DataFrame) -> DataFrame:
    """Ask for those documents once more."""
    j = documents.join(touched.select("document_id").distinct().withColumn("_more", F.lit(1)), "document_id", "left")
    return j.withColumn("work_requested", F.coalesce("work_requested", F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_more").select(*documents.columns)


def meta_overrides(reviews: DataFrame, meta_fields: DataFrame) -> DataFrame:
    """What reviews of a page's meta fields (field_id, page_id, meta_key) say: a value, or null for an empty one; illegible
    says nothing, and dates' parts are read off the date."""
    r = effective_reviews(reviews).where("verdict IN ('value', 'empty')").select("field_id", "verdict", "value")
    f = meta_fields.where(~F.col("meta_key").isin("date.month", "date.day"))
    return f.join(r, "field_id").select("page_id", "meta_key", F.lit("review").alias("source"), F.when(F.col("verdict") == "value", F.col("value")).alias("value"))


def page_fields(fields: DataFrame, pages: DataFrame, reviews: DataFrame, seed: str, n: int, audit: bool = False) -> DataFrame:
    """Fields outside tables to review; with ``audit`` a sample by form of those that the machine was sure of."""
    f = fields.where("region = 'fields'").join(pages.where("status = 'loaded'").select("page_id", "template_name"), "page_id")
    return stratified(queue(f, reviews, F.col("review_status") == "auto"), ["template_name"], "field_id", seed, n) if audit else queue(f, reviews)


def meta_check(meta: DataFrame, reviews: DataFrame) -> DataFrame:
    """Meta values that machine and people disagree on, whose field nobody has reviewed."""
    return queue(meta.where("field_id IS NOT NULL"), reviews, F.col("check_result") == "mismatch")


def readings(fields: DataFrame) -> DataFrame:
    """Pages with waiting cells in formatted tables, all such cells of a page together."""
    f = fields.where((F.col("format") != "integer") & (F.col("region") != "fields"))
    g = f.groupBy("page_id").agg(F.count_if(F.col("review_status") == "pending").alias("waiting"), F.array_sort(F.collect_list(F.struct("region", "row_no", "x0", "field_id"))).alias("cells"))
    return g.where("waiting > 0")


def ask_dotted(role: Column, slot: Column, form: Column, value: Column) -> Column:
    """Whether to ask if a meter's start or end was meant as a time of day."""
    return F.coalesce((role == "meter") & slot.isin("start", "end") & (form == "reading") & fmt.dotted_clock(value).isNotNull(), F.lit(False))


def progress(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """By kind of cell: waiting, reviewed, and how often the effective review kept the machine's value."""
    e = effective_reviews(reviews).select("field_id", "verdict", "value")
    j = fields.join(e, "field_id", "left")
    same = F.when(F.col("verdict") == "value", F.col("value").eqNullSafe(F.col("value_raw"))).when(F.col("verdict") == "empty", F.coalesce(F.col("has_value_raw"), F.lit(0)) == 0)
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("review_status") == "pending").alias("waiting"), F.count("verdict").alias("reviewed"), F.count_if(same).alias("machine_was_right"))
