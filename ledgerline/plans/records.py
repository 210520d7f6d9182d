"""Queries over stored records: documents, pages, fields, reviews and business rows, made from the tables at hand.

The records are given by expressions that both engines take alike; the queries' SQL is written for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import dates, formats, ids, stats, text
from ..operators import cells, continuity, diff, evaluate, export, handlers, latest, precedence, report, review, sampling, sheets, templates, usage
from ..sources import files, recognizers, sinks
from ..sources.files import table
from ..sources.scratch import materialise, new_path
from ..streaming import worker
from .catalog import query

_S = lambda x: f"CAST({x} AS STRING)"
#: name: (rows made of, (column, how many rows of one, condition), columns)
RECORDS: dict[str, tuple[str, tuple[str, int, str] | None, dict[str, str]]] = {
    "docs": ("o", None, {
        "document_id": f"'d' || {_S('k')}", "source_name": f"'scan' || {_S('k % 40')} || '.pdf'", "source_path": f"'/in/' || {_S('c % 9')} || '/f' || {_S('k')}",
        "source_rel": f"CASE WHEN k % 3 = 0 THEN 'intake/' || substr(day, 1, 7) || '/f' || {_S('k')} WHEN k % 3 = 1 THEN 'site/' || {_S('c % 9')} || '/f' || {_S('k')} END", "work_date": "CASE WHEN k % 17 <> 0 THEN day END",
        "date_source": "CASE k % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'label' WHEN 2 THEN 'filename' END", "n_pages": "1 + k % 3", "warning": "CASE WHEN k % 23 = 0 THEN 'far' END", "received_at": "day || 'T08:00:00.000Z'",
        "status": "CASE WHEN st = 'F' THEN 'processed' WHEN st = 'P' THEN 'failed' WHEN k % 5 = 0 THEN 'received' WHEN k % 5 = 1 THEN 'discarded' WHEN k % 5 = 2 THEN 'needs_date' ELSE 'processed' END", "work_requested": "k % 3", "work_done": "k % 2", "k": "k",
    }),
    "pages": ("o", ("n", 3, "n <= 1 + k % 3"), {
        "page_id": f"'d' || {_S('k')} || '-p' || {_S('n')}", "document_id": f"'d' || {_S('k')}", "page_no": "n", "template_name": f"'t' || {_S('(k + n) % 4')}", "classify_margin": "CAST((k * 7 + n) % 50 AS DOUBLE) / 10", "rotation": "CASE WHEN (k + n) % 13 = 0 THEN 90 ELSE 0 END",
        "duplicate_sim": "CASE WHEN (k * 7 + n) % 11 = 1 THEN CAST(80 + (k * 3 + n) % 20 AS DOUBLE) / 100 END", "work_date": "CASE WHEN k % 17 <> 0 THEN day END", "align_inliers": "(k * 5 + n) % 200",
        "status": "CASE (k * 7 + n) % 11 WHEN 0 THEN 'align_failed' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'blank' WHEN 3 THEN 'error' ELSE 'loaded' END", "k": "k", "c": "c", "n": "n",
    }),
    "cells0": ("pages", ("r", 6, "status = 'loaded'"), {
        "page_id": "page_id", "work_date": "work_date", "template_name": "template_name", "k": "k", "c": "c", "n": "n", "r": "r", "h": "(k * 31 + n * 17 + r * 7) % 97", "region": "CASE WHEN r = 1 THEN 'fields' ELSE 'tab' END", "row_no": "CASE WHEN r = 1 THEN -1 ELSE r % 2 END",
    }),
    "fields": ("cells0", None, {
        "field_id": f"page_id || ':' || region || ':f' || {_S('r')} || ':' || {_S('row_no')}", "page_id": "page_id", "work_date": "work_date", "template_name": "template_name", "region": "region", "row_no": "row_no", "field_name": f"'f' || {_S('r')}",
        "kind": "CASE r WHEN 1 THEN 'handwritten_text' WHEN 2 THEN 'handwritten_number' WHEN 3 THEN 'handwritten_number' WHEN 4 THEN 'signature' WHEN 5 THEN 'checkmark' ELSE 'printed' END", "format": "CASE r WHEN 2 THEN 'integer' WHEN 3 THEN 'reading' END",
        "row_key": f"CASE WHEN r = 1 THEN '' ELSE 'k' || {_S('r % 2')} END", "x0": "r * 10", "y0": "20 + row_no * 30", "x1": "r * 10 + 8", "y1": "45 + row_no * 30", "has_value_raw": "CASE WHEN h % 5 = 0 THEN 0 ELSE 1 END", "has_value": "CASE WHEN h % 5 = 0 OR h % 7 = 0 THEN 0 ELSE 1 END",
        "value_raw": f"CASE WHEN h % 5 = 0 THEN '' WHEN r = 2 THEN {_S('h')} WHEN r = 3 AND h % 3 = 0 THEN '0' || {_S('h % 10')} || '.' || {_S('10 + h % 50')} WHEN r = 3 THEN {_S('h')} || '.5' ELSE 'v' || {_S('h')} END",
        "value_final": f"CASE WHEN h % 8 = 1 THEN NULL WHEN h % 5 = 0 THEN '' WHEN r = 2 THEN {_S('h')} WHEN r = 3 THEN {_S('h')} || '.5' ELSE 'v' || {_S('h')} END", "confidence": "CAST(h AS DOUBLE) / 97", "backend": "CASE WHEN h % 5 = 0 THEN 'ink' WHEN r = 2 OR r = 3 THEN 'digits' END",
        "status_raw": "CASE WHEN h % 4 = 1 THEN 'pending' ELSE 'auto' END", "review_status": "CASE WHEN h % 8 = 1 THEN 'pending' WHEN h % 8 = 5 THEN 'reviewed' ELSE 'auto' END", "reviewed_by": "CASE WHEN h % 16 = 1 THEN 'kim' WHEN h % 8 = 5 THEN 'lee' END", "k": "k", "c": "c", "n": "n", "r": "r", "h": "h",
    }),
    "meta0": ("pages", ("m", 3, "status = 'loaded'"), {"page_id": "page_id", "g": "(k * 13 + n * 5 + m * 3) % 89", "m": "m", "meta_key": "CASE m WHEN 1 THEN 'vehicle_no' WHEN 2 THEN 'operator' ELSE 'equipment' END"}),
    "meta": ("meta0", None, {
        "page_id": "page_id", "meta_key": "meta_key", "value": f"CASE WHEN g % 9 <> 0 THEN 'v' || {_S('g % 12')} END", "source": "CASE WHEN g % 9 = 0 THEN NULL WHEN g % 4 = 0 THEN 'review' WHEN g % 4 = 1 THEN 'label' ELSE 'machine' END", "field_id": "CASE WHEN m < 3 THEN page_id || ':fields:f1:-1' END",
        "machine_value": f"CASE WHEN g % 5 <> 0 THEN 'v' || {_S('g % 13')} END", "machine_status": "CASE g % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pending' WHEN 2 THEN 'unlisted' ELSE 'auto' END", "machine_confidence": "CAST(g AS DOUBLE) / 89",
        "check_result": "CASE WHEN g % 7 = 0 THEN 'mismatch' WHEN g % 7 = 1 THEN 'none' WHEN g % 7 = 2 THEN 'unread' ELSE 'match' END",
    }),
    "haul0": ("pages", ("q", 4, "status = 'loaded' AND work_date IS NOT NULL"), {"page_id": "page_id", "day": "substr(work_date, 1, 7) || '-01'", "c": "c", "k": "k", "n": "n", "q": "q", "g": "(k * 11 + n * 7 + q * 5) % 83", "log": "(k + n) % 2 = 0"}),
    "haul": ("haul0", None, {
        "haul_id": f"page_id || ':h' || {_S('q')}", "work_date": "day", "source_form": "'t'", "source_role": "CASE WHEN log THEN 'log' ELSE 'matrix' END", "page_id": "page_id", "slot": f"CASE WHEN NOT log OR k % 3 <> 0 THEN 's' || {_S('c % 5')} END", "vehicle_no": f"'v' || {_S('c % 7')}",
        "operator": f"'o' || {_S('c % 6')}", "material": f"'m' || {_S('q % 2')}", "level": f"'l' || {_S('CAST(floor(q / 2) AS BIGINT)')}", "shift": "CASE WHEN k % 2 = 0 THEN 'day' ELSE 'night' END", "has_value": "CASE WHEN g % 6 = 0 THEN 0 ELSE 1 END", "has_value_raw": "CASE WHEN g % 6 = 0 THEN 0 ELSE 1 END",
        "trips": "CASE WHEN g % 6 <> 0 AND g % 13 <> 0 THEN g END", "trips_raw": "CASE WHEN g % 6 <> 0 THEN g END", "confidence": "CAST(g AS DOUBLE) / 83", "review_status": "CASE WHEN g % 10 = 3 THEN 'pending' ELSE 'auto' END", "source_field_id": f"page_id || ':tab:f' || {_S('q + 1')} || ':' || {_S('(q + 1) % 2')}", "g": "g",
    }),
}
_O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS st FROM orders)"


def _sql(*names: str) -> str:
    """The records' tables as common table expressions, those that they are made of before them."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name == "o" or name in out:
            return
        source, times, columns = RECORDS[name]
        add(source)
        more = f", (SELECT unnest(range(1, {times[1] + 1})) AS {times[0]}) WHERE {times[2]}" if times else ""
        out[name] = f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}{more})"

    for n in names:
        add(n)
    return ", ".join([_O, *out.values()])


_made: dict[tuple[str, str, str], DataFrame] = {}


def record(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A record's table, made once for a folder and session: stored records are tables, not expressions."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        _made[key] = materialise(_record(spark, d, name), f"record-{name}")[0]
    return _made[key]


def _record(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name == "o":
        return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("st"))
    source, times, columns = RECORDS[name]
    rows = _record(spark, d, source)
    if times:
        rows = rows.withColumn(times[0], F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times[1]).cast("long")))).where(times[2])
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _get(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(record(spark, d, n) for n in names)


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.tiff' WHEN 3 THEN '.txt' WHEN 4 THEN '.pdf.bak' ELSE '' END AS path FROM pages)
SELECT page_id, regexp_matches(lower(path), '[.](png|jpg|jpeg|tif|tiff|bmp|pdf)$') AS supported FROM p""")
def supported_files(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".png", ".tiff", ".txt", ".pdf.bak", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", files.is_supported(F.concat("url", end)).alias("supported"))


@query(f"""
WITH {_sql('docs')}
SELECT document_id, CASE WHEN k % 4 = 0 THEN source_path WHEN coalesce(source_rel, '') <> '' THEN '/archive/' || source_rel END AS place FROM docs""")
def original_paths(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = _get(spark, d, "docs")
    return docs.select("document_id", files.resolve_source(F.col("source_path"), F.col("k") % 4 == 0, F.col("source_rel"), "/archive/").alias("place"))


_DECIDED = """
e AS (SELECT 'd' || user_id AS target, event_id, CASE event_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'discard' WHEN 2 THEN 'restore' ELSE 'keep' END AS kind, strftime(ts, '%Y-%m-%d') AS value, event_id % 3 AS batch FROM events),
"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("date", "discard", "restore", "keep")]), (i % 4 + 1).cast("int"))
    return table(spark, d, "events").select(
        i.alias("event_id"), F.lpad(i.cast("string"), 12, "0").alias("decision_id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("target"), kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("value"), F.lit("kim").alias("decided_by"), F.date_format("ts", "yyyy-MM-dd").alias("decided_at"), F.lit(None).cast("string").alias("note"),
    )


@query(f"""
WITH {_DECIDED}
s AS (SELECT *, row_number() OVER (ORDER BY batch, lpad(event_id::VARCHAR, 12, '0')) AS seq FROM e)
SELECT target, arg_max(value, seq) FILTER (kind = 'date') AS "date", coalesce(arg_max(CASE WHEN kind = 'discard' THEN 1 ELSE 0 END, seq) FILTER (kind IN ('discard', 'restore')), 0) AS discarded,
       coalesce(max(1) FILTER (kind = 'keep'), 0) AS keep FROM s GROUP BY target""")
def decisions_of_a_log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions appended to a log in three batches, read back: a later batch wins, whatever its ids."""
    log, rows = new_path(spark, "decision-log"), _decided(spark, d)
    for batch in range(3):
        sinks.append_jsonl(rows.where(F.col("event_id") % 3 == batch).drop("event_id"), log, ["decision_id"])
    return latest.effective_decisions(files.decisions(spark, log))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'r1' WHEN o_orderkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS received
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0""")
def merged_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table kept as versions 9, 10 and 11: what an earlier one inserted keeps its insertion's columns."""
    at, o = new_path(spark, "versions"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    say = lambda cond, status, received: o.where(cond).select("o_orderkey", status.alias("o_orderstatus"), F.lit(received).alias("received"))
    sinks.merge_table(spark, at, say("o_orderkey % 5 = 0", F.col("o_orderstatus"), "r1"), ["o_orderkey"], ["received"], "v9")
    sinks.merge_table(spark, at, say("o_orderkey % 3 = 0", F.lit("X"), "r2"), ["o_orderkey"], ["received"], "v10")
    more = o.where("o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", F.lit("r1").alias("received"))
    return spark.read.parquet(sinks.merge_table(spark, at, more, ["o_orderkey"], ["received"], "v11"))


@query("""
WITH bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 50 = 7 AND o_orderkey % 11 <> 0)
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_custkey IN (SELECT o_custkey FROM bad) THEN o_orderkey % 7 <> 0 ELSE o_orderkey % 11 <> 0 END""")
def published_rows(spark: SparkSession, d: str) -> DataFrame:
    """A target after publishing: customers with a value that targets refuse keep their old orders, all others get the
    new ones."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 50 == 7, F.concat("o_orderstatus", F.lit("\x00"))).otherwise(F.col("o_orderstatus"))
    now, at = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", status), new_path(spark, "published")
    sinks.publish(now, o.where("o_orderkey % 7 <> 0"), now, ["o_custkey"], ["o_orderkey", "o_orderstatus"], lambda df: df.write.parquet(at))
    return spark.read.parquet(at)


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_custkey, bool_or(o_orderkey % 50 = 7) AS bad FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1),
ch AS (SELECT o_custkey, bool_or((o_orderkey % 7 <> 0) <> (o_orderkey % 11 <> 0) OR (o_orderkey % 11 <> 0 AND o_orderkey % 50 = 7)) AS changed FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'remove' WHEN b.bad THEN 'skip' ELSE 'replace' END AS action FROM ch LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey) WHERE changed AND (a.o_custkey IS NOT NULL OR b.o_custkey IS NOT NULL)""")
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 50 == 7, F.concat("o_orderstatus", F.lit("\x00"))).otherwise(F.col("o_orderstatus"))
    now = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", status)
    return sinks.publish(now, o.where("o_orderkey % 7 <> 0"), now, ["o_custkey"], ["o_orderkey", "o_orderstatus"], lambda df: None, check=True)


@query(f"WITH {_sql('pages', 'fields')} SELECT p.page_id, f.field_id FROM pages p LEFT JOIN fields f USING (page_id) WHERE p.k % 5 <> 0")
def pages_deleted(spark: SparkSession, d: str) -> DataFrame:
    pages, fields = _get(spark, d, "pages", "fields")
    left = diff.delete_pages({"doc_page": pages, "doc_field": fields}, pages.where("k % 5 = 0"))
    return left["doc_page"].select("page_id").join(left["doc_field"].select("page_id", "field_id"), "page_id", "left")


@query("""
WITH n AS (SELECT c_custkey AS k, c_mktsegment AS h FROM customer WHERE c_custkey % 4 <> 0), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(n.k, o.k) || '.xlsx' AS path, CASE WHEN n.k IS NULL THEN 'remove' ELSE 'replace' END AS action FROM n FULL OUTER JOIN o ON n.k = o.k WHERE n.k IS NULL OR o.k IS NULL OR n.h <> o.h""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    path = F.concat(k.cast("string"), F.lit(".xlsx")).alias("path")
    made, known = c.where(k % 4 != 0).select(path, F.col("c_mktsegment").alias("hash")), c.where(k % 3 != 0).select(path, F.when(k % 5 == 0, "old").otherwise(F.col("c_mktsegment")).alias("hash"))
    return sinks.manifest_changes(made, known, False)


@query(f"""
WITH {_sql('fields')}
SELECT page_id, field_id, greatest(0, x0 - 4) AS x0, greatest(0, y0 - 4) AS y0, x1 + 4 AS x1, y1 + 4 AS y1 FROM fields WHERE kind IN ('signature', 'handwritten_text') OR (region = 'fields') OR r = 6 AND k % 2 = 0""")
def masked_boxes(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    return sinks.mask_boxes(f.withColumn("is_meta", F.col("region") == "fields").withColumn("redact", (F.col("r") == 6) & (F.col("k") % 2 == 0)))


@query(f"""
WITH {_sql('fields')}, s AS (SELECT *, CASE WHEN coalesce(work_date, '') = '' THEN 'unknown' WHEN ('0x' || substr(sha256('s:' || work_date), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM fields)
SELECT split, count(*) AS n, count(value_final) AS n_values FROM s WHERE kind LIKE 'handwritten%' GROUP BY 1""")
def answers_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as JSON, a folder for each split, and read back."""
    (f,) = _get(spark, d, "fields")
    at = new_path(spark, "answers")
    sinks.write_by_split(f.where(F.col("kind").startswith("handwritten")).select("field_id", "work_date", "value_final"), at, ids.split_of(F.col("work_date"), "s"))
    return spark.read.schema("field_id string, work_date string, value_final string, split string").json(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("value_final").alias("n_values"))


@query(f"WITH {_sql('fields')} SELECT field_id, work_date, value_final FROM fields WHERE kind = 'handwritten_number' AND work_date IS NOT NULL AND ('0x' || substr(sha256('s:' || work_date), 1, 8))::BIGINT / 4294967296.0 >= 0.2")
def training_crops(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    split = ids.split_of(F.col("work_date"), "s")
    own = f.where((F.col("kind") == "handwritten_number") & (split == "train")).select("field_id", "work_date", "value_final")
    return files.training_rows(own, F.col("work_date"), split)


@query(f"WITH {_sql('fields')} SELECT page_id, field_id, CAST(floor(greatest(0, (x0 - 3) * 2.5)) AS INTEGER) AS x0, CAST(floor(greatest(0, (y0 - 3) * 2.5)) AS INTEGER) AS y0, CAST(least(150, ceil((x1 + 3) * 2.5)) AS INTEGER) AS x1, CAST(least(110, ceil((y1 + 3) * 2.5)) AS INTEGER) AS y1 FROM fields WHERE row_no >= 0")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    spec = cells.crop_spec(("x0", "y0", "x1", "y1"), 3, F.lit(150), F.lit(110), F.lit(2.5))
    return f.where("row_no >= 0").select("page_id", "field_id", spec.alias("s")).select("page_id", "field_id", "s.*")


# --- functions -------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'odd' WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END END AS d FROM orders)
SELECT CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}-') THEN substr(d, 1, 7) END AS "month", count(*) AS n, count(*) FILTER (d >= '1995-03-' AND d < '1995-03.') AS in_march FROM t GROUP BY 1""")
def months_of_days(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(k % 9 == 0, "odd").when(k % 13 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 4 == 0, "x").otherwise("")))
    return table(spark, d, "orders").select(day.alias("d")).groupBy(dates.month_of(F.col("d")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(dates.in_month(F.col("d"), "1995-03")).alias("in_march"))


@query("SELECT n.v AS canonical, s.x AS spelling FROM (SELECT DISTINCT lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '00' ELSE '30' END AS v FROM orders) n, LATERAL (SELECT DISTINCT unnest(list_concat([left(v, 2) || ':' || right(v, 2), left(v, 2)::INT || ':' || right(v, 2), left(v, 2) || '.' || right(v, 2), left(v, 2)::INT || '.' || right(v, 2), left(v, 2) || right(v, 2), left(v, 2)::INT || right(v, 2)], CASE WHEN right(v, 2) = '00' THEN [left(v, 2), left(v, 2)::INT::VARCHAR] ELSE [] END)) AS x) s")
def time_spellings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.when(k % 2 == 0, ":00").otherwise(":30"))
    return table(spark, d, "orders").select(v.alias("canonical")).distinct().select("canonical", F.explode(formats.spellings(F.lit("time"), F.col("canonical"))).alias("spelling"))


@query(f"""
WITH {_sql('fields')}
SELECT field_id, CASE WHEN coalesce(value_final, '') = '' OR value_raw = '' THEN value_raw = coalesce(value_final, '')
       ELSE value_raw = value_final OR (regexp_full_match(value_raw, '[0-9]{{1,2}}[.][0-9]{{2}}') AND split_part(value_raw, '.', 2)::INT < 60 AND lpad(split_part(value_raw, '.', 1), 2, '0') || ':' || split_part(value_raw, '.', 2) = value_final)
            OR coalesce(regexp_replace(value_raw, '^0+([0-9])', '\\1') = value_final, false) END AS same FROM fields WHERE r = 3""")
def same_readings(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    return f.where("r = 3").select("field_id", formats.same_value(F.col("format"), F.col("value_raw"), F.col("value_final")).alias("same"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_custkey || '.25' WHEN 2 THEN 'x' || o_custkey WHEN 3 THEN '' ELSE NULL END AS v, ['integer', 'decimal', 'time'][1 + o_orderkey % 3] AS f FROM orders)
SELECT o_orderkey, CASE WHEN f = 'integer' AND regexp_full_match(v, '[0-9]+') THEN 'int' WHEN f = 'decimal' AND regexp_full_match(v, '[0-9]+([.][0-9]+)?') THEN 'float' ELSE 'text' END AS kind, regexp_replace(v, '[0-9]', 'd', 'g') AS shape FROM t""")
def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    v = F.when(k % 5 == 0, c).when(k % 5 == 1, F.concat(c, F.lit(".25"))).when(k % 5 == 2, F.concat(F.lit("x"), c)).when(k % 5 == 3, "")
    f = F.element_at(F.array(*[F.lit(x) for x in ("integer", "decimal", "time")]), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", formats.typed(f, v)["kind"].alias("kind"), formats.shape_of(v).alias("shape"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE concat_ws('-', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE '20' || strftime(o_orderdate, '%y') END, strftime(o_orderdate, '%m'), strftime(o_orderdate, '%d')) END AS "day" FROM orders""")
def dates_of_names(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(k % 4 == 3, F.lit("notes.pdf")).when(k % 2 == 0, F.concat(F.lit("scan_"), F.date_format(x, "yyyy_MM_dd"), F.lit(".pdf"))).otherwise(F.concat(F.lit("scan_"), F.date_format(x, "yy_M_d"), F.lit(".pdf")))
    return table(spark, d, "orders").select("o_orderkey", dates.date_from_name(name, "scan_([0-9]{2,4})_([0-9]{1,2})_([0-9]{1,2})").alias("day"))


@query("""
SELECT event_id, substr(sha256(user_id || '|' || event_type || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id::VARCHAR END), 1, 16) AS id, 'd' || user_id AS document_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 9)::INTEGER END AS page_no,
       'p' || user_id || ':r:' || event_type || ':' || event_id % 7 AS field_id FROM events""")
def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("event_id"), lambda c: F.col(c).cast("string")
    target = F.concat(F.lit("d"), s("user_id"), F.when(i % 2 == 0, F.concat(F.lit("-p"), (i % 9).cast("string"))).otherwise(""))
    part = ids.page_parts(target)
    return table(spark, d, "events").select("event_id", ids.joined_id(F.col("user_id"), F.col("event_type"), F.when(i % 3 != 0, i)).alias("id"), part["document_id"].alias("document_id"), part["page_no"].alias("page_no"), ids.field_id(F.concat(F.lit("p"), s("user_id")), F.lit("r"), F.col("event_type"), i % 7).alias("field_id"))


@query("""
SELECT event_id, 'failed at postgresql://***@db' || user_id || '/x, password=*** and token: ***' AS message FROM events""")
def scrubbed_messages(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    said = F.concat(F.lit("failed at postgresql://u"), s("event_id"), F.lit(":pw"), s("user_id"), F.lit("@db"), s("user_id"), F.lit("/x, password="), F.col("event_type"), s("event_id"), F.lit(" and token: 'a b'"))
    return table(spark, d, "events").select("event_id", text.scrub(said).alias("message"))


@query("""
SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS name, epoch_us(ts) // 1000 AS ms, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day FROM events""")
def received_names(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", ms.alias("given"), F.col("ts").cast("timestamp").alias("at"))
    e = e.select("event_id", worker.stamp_name(F.col("given")).alias("name"), F.date_format(dates.local_day(F.col("at"), "Asia/Seoul"), "yyyy-MM-dd").alias("local_day"))
    return e.select("event_id", "name", worker.stamp_of_name(F.concat(F.lit("intake/x/"), "name", F.lit("-id/f.pdf"))).alias("ms"), "local_day")


# --- intake and rounds -----------------------------------------------------------------------------------------------

_INBOX = """
f AS (SELECT 'f' || c_custkey AS path, c_custkey * 10 AS length, (c_custkey % 100)::DOUBLE AS modified, CASE WHEN c_custkey % 19 <> 0 THEN 'd' || (c_custkey % 700) END AS document_id FROM customer),
s AS (SELECT 'f' || c_custkey AS path, c_custkey * 10 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS seen_length, (c_custkey % 90)::DOUBLE AS first_seen FROM customer WHERE c_custkey % 7 <> 0),
j AS (SELECT f.*, coalesce(first_seen, 100.0) AS first_seen, CASE WHEN coalesce(seen_length = f.length AND 100 - modified >= 10 AND f.length > 0, false) THEN 'ready' WHEN 100 - coalesce(first_seen, 100.0) >= 60 THEN 'failed' ELSE 'wait' END AS state FROM f LEFT JOIN s USING (path)),
"""


def _inbox(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("c_custkey")
    c, name = table(spark, d, "customer"), F.concat(F.lit("f"), k.cast("string")).alias("path")
    found = c.select(name, (k * 10).alias("length"), (k % 100).cast("double").alias("modified"), F.when(k % 19 != 0, F.concat(F.lit("d"), (k % 700).cast("string"))).alias("document_id"))
    seen = c.where(k % 7 != 0).select(name, (k * 10 + (k % 11 == 0).cast("int")).alias("length"), (k % 90).cast("double").alias("first_seen"))
    known = c.where((k < 700) & (k % 5 == 0)).select(F.concat(F.lit("d"), k.cast("string")).alias("document_id"))
    return worker.inbox_round(found, known, seen, 100.0, 10.0, 60.0, 100_020, "/archive")


@query(f"""
WITH {_INBOX}
n AS (SELECT document_id, min(path) AS path FROM j WHERE state = 'ready' AND document_id IS NOT NULL AND document_id NOT IN (SELECT 'd' || c_custkey FROM customer WHERE c_custkey < 700 AND c_custkey % 5 = 0) GROUP BY 1)
SELECT document_id, path, (100020 + row_number() OVER (ORDER BY path))::BIGINT AS stamp, 'received' AS status FROM n""")
def inbox_registered(spark: SparkSession, d: str) -> DataFrame:
    return _inbox(spark, d)["register"].select("document_id", "path", "stamp", "status")


@query(f"""
WITH {_INBOX}
r AS (SELECT path, document_id, document_id IN (SELECT 'd' || c_custkey FROM customer WHERE c_custkey < 700 AND c_custkey % 5 = 0) AS known, min(path) OVER (PARTITION BY document_id) AS first FROM j WHERE state = 'ready' AND document_id IS NOT NULL)
SELECT 'already' AS what, path FROM r WHERE known OR path <> first
UNION ALL SELECT 'failed', path FROM j WHERE state = 'failed' OR (state = 'ready' AND document_id IS NULL AND 100 - first_seen >= 60)""")
def inbox_put_aside(spark: SparkSession, d: str) -> DataFrame:
    got = _inbox(spark, d)
    return got["already"].select(F.lit("already").alias("what"), "path").unionByName(got["failed"].select(F.lit("failed").alias("what"), "path"))


@query("""
WITH e AS (SELECT event_id, epoch_ms(ts) // 100000 AS ms, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, (i + max(ms - i) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stamp FROM e""")
def received_in_order(spark: SparkSession, d: str) -> DataFrame:
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100_000)
    return worker.received_stamps(table(spark, d, "events").select("event_id", ms.alias("ms")), ["event_id"], None).select("event_id", "stamp")


@query(f"""
WITH {_sql('docs')}, p AS (SELECT document_id, work_requested AS asked FROM docs WHERE k % 4 = 1)
SELECT document_id, greatest(work_done, coalesce(asked, 0)) AS work_done, status = 'received' OR work_requested > greatest(work_done, coalesce(asked, 0)) AS waits FROM docs LEFT JOIN p USING (document_id)""")
def work_marked_done(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = _get(spark, d, "docs")
    done = worker.mark_done(docs, docs.where("k % 4 = 1").select("document_id", F.col("work_requested").alias("asked")))
    return done.join(worker.pending(done).select("document_id", F.lit(True).alias("waits")), "document_id", "left").select("document_id", "work_done", F.coalesce("waits", F.lit(False)).alias("waits"))


@query(f"""
WITH {_sql('pages')}
SELECT substr(work_date, 1, 7) AS slice, count(*) AS pages, count(*) FILTER (status = 'loaded') AS loaded FROM pages GROUP BY 1""")
def swept_months(spark: SparkSession, d: str) -> DataFrame:
    """Pages counted in a full sweep, a month a round."""
    (pages,) = _get(spark, d, "pages")
    at = new_path(spark, "sweep")

    def count(month: str | None) -> None:
        part = pages.where(worker.in_slice(F.col("work_date"), month))
        part.groupBy(F.lit(month).cast("string").alias("slice")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "loaded").alias("loaded")).coalesce(1).write.mode("append").parquet(at)

    months = worker.sweep(pages.where("work_date >= '1998'"), "work_date", count)
    rest = pages.where((F.col("work_date") < "1998")).groupBy(F.substring("work_date", 1, 7).alias("slice")).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "loaded").alias("loaded"))
    return spark.read.schema("slice string, pages long, loaded long").parquet(at).unionByName(rest) if months else rest
