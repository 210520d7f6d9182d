"""Counts of what is stored, as rows of (section, key, n), and tables by day and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import dotted_clock


def counts(df: DataFrame, section: str, key: Column) -> DataFrame:
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")


def totals(df: DataFrame, section: str, **conditions: Column) -> DataFrame:
    """Several conditional counts of one table in one pass."""
    pairs = [F.struct(F.lit(k).alias("key"), F.count_if(c).alias("n")) for k, c in conditions.items()]
    return df.agg(F.array(*pairs).alias("p")).select(F.lit(section).alias("section"), F.inline("p"))


def summary(t: dict[str, DataFrame]) -> DataFrame:
    """The report over all tables that are there."""
    c, true = F.col, F.lit(True)
    parts: list[DataFrame] = []
    if "doc_document" in t:
        d = t["doc_document"]
        parts += [totals(d, "documents", all=true, warnings=c("warning").isNotNull(), waiting=(c("status") == "received") | (c("work_requested") > c("work_done"))), counts(d, "documents_by_status", c("status")), counts(d, "documents_by_date_source", F.coalesce("date_source", F.lit("none")))]
    if "doc_page" in t:
        p = t["doc_page"]
        parts += [totals(p, "pages", all=true, rotated=F.coalesce(c("rotation") != 0, F.lit(False)), near_tie=near_tie(c("variant_errs"))), counts(p, "pages_by_form", c("template_name")), counts(p, "pages_by_status", c("status"))]
    if "doc_field" in t:
        f = t["doc_field"]
        parts += [totals(f, "fields", total=true, with_value=c("has_value") == 1, pending=c("review_status") == "pending", reviewed=c("review_status") == "reviewed")]
    if "insp_daily" in t:
        parts += [totals(t["insp_daily"], "inspection", rows=true, auto=c("review_status") == "auto", abnormal_yes=c("abnormal") == 1, abnormal_no=c("abnormal") == 0, abnormal_undecided=c("abnormal").isNull())]
    if "prod_haul" in t:
        h = t["prod_haul"]
        parts += [totals(h, "haul", cells=true, filled=c("has_value") == 1, with_trips=c("trips").isNotNull()), counts(h.where("has_value = 1"), "haul_filled_by_role", c("source_role"))]
    if "xcheck_haul" in t:
        x = t["xcheck_haul"]
        parts += [counts(x, "xcheck_haul", c("status"))]
        for name, a, b in (("final", "log_trips", "matrix_trips"), ("raw", "log_trips_raw", "matrix_trips_raw")):
            parts.append(totals(x, f"xcheck_agreement_{name}", both=c(a).isNotNull() & c(b).isNotNull(), same=c(a) == c(b)))
    if "eq_usage_daily" in t:
        u = t["eq_usage_daily"]
        parts += [totals(u, "usage", pages=true, pending=c("review_status") == "pending", with_equipment=c("equipment").isNotNull(), with_equipment_id=c("equipment_id").isNotNull(), dotted_suspect=(c("reading_kind") == "meter") & (c("meter_start") <= 24) & (c("meter_end") <= 24)), counts(u, "usage_reading", c("reading_kind")), counts(u, "usage_hours_basis", F.coalesce("hours_basis", F.lit("none")))]
    if "xcheck_usage" in t:
        parts += [counts(t["xcheck_usage"], "xcheck_usage", F.concat_ws(".", "check_kind", "result"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_tie(errs: Column, px: float = 1.0) -> Column:
    """Whether the two smallest of a map's known errors are close."""
    v = F.array_sort(F.filter(F.map_values(errs), lambda x: x.isNotNull()))
    return F.coalesce((F.size(v) >= 2) & (F.get(v, F.lit(1)) - F.get(v, F.lit(0)) < px), F.lit(False))


def upper_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of each group the value at half its number, counted from 0, nulls left out. Values are counted first, so a window
    goes over a group's distinct values and not over its rows."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    n = n.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    return n.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(value))


def by_month(pages: DataFrame, low_margin: float = 1.5) -> DataFrame:
    """Forms by month: pages by outcome, least inliers, upper median and maximum of the grid error, low margins."""
    c, key = F.col, ["template", "month"]
    p = pages.withColumn("template", F.coalesce("template_name", F.lit("unknown"))).withColumn("month", F.coalesce(F.substring("work_date", 1, 7), F.lit("unknown")))
    g = p.groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(c("status") == s).alias(s) for s in ("loaded", "align_failed", "error", "classified_only")], F.min("align_inliers").alias("min_inliers"), F.count_if(c("classify_margin") < low_margin).alias("low_margin"), F.round(F.max("align_grid_err"), 2).alias("grid_err_max"))
    mid = upper_medians(p, key, "align_grid_err").select(*key, F.round("align_grid_err", 2).alias("grid_err_median"))
    return g.join(mid, key, "left")


def by_backend(fields: DataFrame) -> DataFrame:
    c = F.col
    return fields.where(c("kind").startswith("handwritten")).groupBy(F.coalesce("backend", F.lit("unknown")).alias("backend")).agg(F.count(F.lit(1)).alias("fields"), F.count_if(c("status_raw") == "auto").alias("auto"), F.count_if(c("review_status") == "pending").alias("pending"), F.count_if(c("review_status") == "reviewed").alias("reviewed"))


def page_meta_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("meta_key", F.coalesce("source", F.lit("none")).alias("source"), "check_result", "machine_status").agg(F.count(F.lit(1)).alias("pages"))


def log_slots(haul: DataFrame, obs: DataFrame, meta: DataFrame) -> DataFrame:
    """Log pages that found a slot, by the source of the value that found it."""
    pages = haul.where("source_role = 'log'").groupBy("page_id").agg(F.max("work_date").alias("work_date"), F.max("slot").alias("slot")).where("slot IS NOT NULL")
    how = pages.join(obs.select("work_date", "slot", "matched_by"), ["work_date", "slot"], "left")
    key = F.when(F.col("matched_by") == "operator", "operator").otherwise("vehicle_no")
    j = how.withColumn("meta_key", key).join(meta.select("page_id", "meta_key", "source"), ["page_id", "meta_key"], "left")
    return j.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("pages"))


def page_slots(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page number of a document from 1 to n_pages, with the page where there is one."""
    every = documents.select("document_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce("n_pages", F.lit(1))).cast("int"))).alias("page_no"))
    return every.join(pages, ["document_id", "page_no"], "left")


def stale_ids(rows: DataFrame, aliases: DataFrame, namespace_id: Column) -> DataFrame:
    """Rows whose stored equipment_id isn't the one that the aliases (name, key) give now; nulls are equal."""
    j = rows.join(aliases.withColumnRenamed("name", "equipment"), "equipment", "left")
    return j.where(~F.col("equipment_id").eqNullSafe(namespace_id)).drop("key")


def variants(pages: DataFrame, families: DataFrame) -> DataFrame:
    """For each family (template, family; else the variants' names) pages by the variant chosen, failed ones, near ties."""
    p = pages.where("variant_errs IS NOT NULL").join(families.withColumnRenamed("template", "template_name"), "template_name", "left")
    group = F.coalesce("family", F.array_join(F.array_sort(F.map_keys("variant_errs")), " / "))
    failed = F.col("status") == "align_failed"
    return p.groupBy(group.alias("family"), F.when(~failed, F.col("template_name")).alias("variant")).agg(F.count_if(~failed).alias("chosen"), F.count_if(failed).alias("align_failed"), F.count_if(~failed & near_tie(F.col("variant_errs"))).alias("near_tie"))


def format_cells(fields: DataFrame) -> DataFrame:
    """Formatted cells that a machine read: accepted values and blanks, waiting ones, dotted times."""
    auto, has = F.col("status_raw") == "auto", F.coalesce(F.col("has_value_raw"), F.lit(0)) != 0
    read = fields.where((F.col("format") != "integer") & (F.coalesce("backend", F.lit("")) != "ink"))
    return read.groupBy("format").agg(F.count(F.lit(1)).alias("read"), F.count_if(auto & has).alias("auto_value"), F.count_if(auto & ~has).alias("auto_empty"), F.count_if(~F.coalesce(auto, F.lit(False))).alias("pending"), F.count_if((F.col("format") == "reading") & dotted_clock(F.col("value_raw")).isNotNull()).alias("dotted"))


def intake(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts of what came in and waits; what there is none of isn't there."""
    c = F.col
    d = totals(documents, "intake", needs_date=c("status") == "needs_date", waiting=(c("status") == "received") | (c("work_requested") > c("work_done")), discarded_documents=c("status") == "discarded")
    p = totals(pages, "intake", discarded_pages=c("status") == "discarded", blank=c("status") == "blank", rotated=F.coalesce(c("rotation") != 0, F.lit(False)), duplicates=c("status") == "duplicate")
    return d.unionByName(p).unionByName(counts(documents, "date_source", F.coalesce("date_source", F.lit("none")))).where("n > 0")


def duplicate_similarity(pages: DataFrame) -> DataFrame:
    held = pages.where("status = 'duplicate' AND duplicate_sim IS NOT NULL")
    return held.agg(F.count(F.lit(1)).alias("pages"), F.min("duplicate_sim").alias("least"), F.median("duplicate_sim").alias("median"), F.max("duplicate_sim").alias("most"))


def list_pages(documents: DataFrame, pages: DataFrame, status: str | None = None, template: str | None = None, margin_below: float | None = None, ties: bool = False, rotated: bool = False) -> DataFrame:
    p = pages
    for use, cond in ((status is not None, F.col("status") == status), (template is not None, F.col("template_name") == template), (margin_below is not None, F.col("classify_margin") < (margin_below or 0.0)), (ties, near_tie(F.col("variant_errs"))), (rotated, F.coalesce(F.col("rotation") != 0, F.lit(False)))):
        p = p.where(cond) if use else p
    named = p.join(documents.select("document_id", "source_name"), "document_id")
    return named.withColumn("source", F.concat_ws("#", "source_name", "page_no")).orderBy("work_date", "source_name", "page_no")


def meta_mismatches(meta: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages where the machine read something else than people's value; without the values."""
    m = meta.where("check_result = 'mismatch'").select("page_id", "meta_key", F.col("source").alias("value_source"), "machine_status", "machine_confidence")
    return m.join(pages.select("page_id", "document_id", "page_no", "work_date", "template_name"), "page_id").join(documents.select("document_id", "source_name"), "document_id")


def usage_by_date(checks: DataFrame, results: list[str]) -> DataFrame:
    """Checks by day, a column for each kind and result given."""
    named = checks.withColumn("what", F.concat_ws(".", "check_kind", "result"))
    return named.groupBy(F.coalesce("work_date", F.lit("unknown")).alias("work_date")).pivot("what", results).agg(F.count(F.lit(1))).na.fill(0, results)


def recent(documents: DataFrame, n: int = 50) -> DataFrame:
    return documents.orderBy(F.desc_nulls_last("received_at"), "document_id").limit(n)
