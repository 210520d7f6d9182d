"""Queries over field rows, page meta, reviews, business rows and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import cells, evaluate, export, handlers, latest, precedence, report, review, sampling, sheets, templates, usage
from ..sources.files import table
from .catalog import query
from .records import _get, _sql

# --- cells and field rows --------------------------------------------------------------------------------------------

_SEEN = """
x AS (SELECT f.*, CASE WHEN h % 3 = 0 THEN 10 ELSE 50 END AS area, CASE WHEN h % 4 = 0 THEN 0.001 ELSE 0.02 END AS ink,
             CASE WHEN h % 6 <> 5 THEN CASE h % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'reject' WHEN 2 THEN NULL ELSE 'value' END END AS answer, h % 6 <> 5 AS there FROM fields f),
w AS (SELECT *, area >= 40 OR ink >= 0.008 AS written, confidence >= 0.4 AS sure FROM x)
"""


def _seen(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = F.col("h")
    made = f.withColumn("area", F.when(h % 3 == 0, 10).otherwise(50)).withColumn("ink", F.when(h % 4 == 0, 0.001).otherwise(0.02))
    answer = F.when(h % 5 == 0, "empty").when(h % 5 == 1, "reject").when(h % 5 != 2, "value")
    read = f.where(h % 6 != 5).select("field_id", F.when(F.col("r") == 2, h.cast("string")).otherwise(F.col("value_raw")).alias("text"), answer.alias("answer"), "confidence", F.lit(None).cast("double").alias("threshold"), F.lit("m").alias("backend"), F.array(F.lit("a")).alias("candidates"))
    return made.drop("confidence", "value_raw", "value_final", "has_value", "has_value_raw", "backend", "review_status", "status_raw"), read


@query(f"""
WITH {_sql('fields')}, {_SEEN}
SELECT field_id, CASE WHEN NOT written THEN 0 WHEN r = 2 AND there AND answer = 'empty' AND sure THEN 0 ELSE 1 END AS has_value,
       CASE WHEN NOT written THEN 'auto' WHEN r = 2 AND there AND sure AND (answer IS NULL OR answer = 'empty' OR (answer = 'value' AND h <= 60)) THEN 'auto' ELSE 'pending' END AS status,
       CASE WHEN written AND r = 2 AND there THEN h::VARCHAR END AS value_final, CASE WHEN NOT written THEN 'ink' WHEN there THEN 'm' END AS backend FROM w WHERE r <> 3""")
def field_rows_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    made, read = _seen(_get(spark, d, "fields")[0].where("r <> 3"))
    return handlers.field_rows(made, read, 0.4, most=60).select("field_id", "has_value", F.col("review_status").alias("status"), "value_final", "backend")


@query(f"""
WITH {_sql('fields')}, {_SEEN},
v AS (SELECT *, regexp_full_match(value_raw, '[0-9]+([.][0-9]+)?') AS fits, regexp_full_match(value_raw, '[0-9]{{1,2}}[.][0-9]{{2}}') AND coalesce(try_cast(split_part(value_raw, '.', 2) AS INT) < 60, false) AS dotted FROM w WHERE r = 3)
SELECT field_id, CASE WHEN NOT written OR (there AND answer = 'empty' AND sure) THEN 0 ELSE 1 END AS has_value,
       CASE WHEN NOT written OR (there AND answer = 'empty' AND sure) OR (there AND (answer IS NULL OR answer = 'value') AND sure AND fits AND NOT dotted) THEN 'auto' ELSE 'pending' END AS status,
       CASE WHEN written AND there AND (answer IS NULL OR answer = 'value') AND sure AND fits AND NOT dotted THEN regexp_replace(value_raw, '^0+([0-9])', '\\1') WHEN NOT written OR (there AND answer = 'empty' AND sure) THEN '' END AS value_final FROM v""")
def field_rows_of_formats(spark: SparkSession, d: str) -> DataFrame:
    made, read = _seen(_get(spark, d, "fields")[0].where("r = 3"))
    return handlers.field_rows(made, read, 0.4, reads=("reading",), empty_final="").select("field_id", "has_value", F.col("review_status").alias("status"), "value_final")


@query(f"""
WITH {_sql('fields')}
SELECT field_id, CASE WHEN r <> 3 THEN value_raw WHEN status_raw = 'pending' THEN NULL WHEN has_value_raw <> 0 THEN CASE WHEN regexp_full_match(value_raw, '[0-9]+([.][0-9]+)?') THEN regexp_replace(value_raw, '^0+([0-9])', '\\1') END ELSE 'none' END AS value FROM fields""")
def machine_values(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    return f.select("field_id", cells.machine_final(f, "none").alias("value"))


_GATE = """
p AS (SELECT p_partkey, p_partkey % 23 AS s, p_partkey % 23 + p_size % 30 AS e, p_size % 30 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS t, p_partkey % 11 = 0 AS waits, p_partkey % 13 = 0 AS no_end FROM part),
g AS (SELECT *, CASE WHEN waits THEN 'pending' WHEN no_end THEN 'incomplete' WHEN e - s > 24 THEN 'range' WHEN t <> e - s THEN 'total' WHEN s <= 24 AND e <= 24 THEN 'clock_like' END AS why FROM p)
"""


@query(f"""
WITH {_GATE}, c AS (SELECT p_partkey, why, waits, unnest(['start', 'end', 'total']) AS name, unnest([s, e, t]) AS v, unnest([false, no_end, false]) AS gone FROM g)
SELECT p_partkey || ':' || name AS field_id, CASE WHEN waits AND name = 'start' THEN 'pending' WHEN why IS NOT NULL AND NOT gone THEN 'pending' ELSE 'auto' END AS status, CASE WHEN why IS NOT NULL AND NOT gone AND NOT (waits AND name = 'start') THEN why END AS reason FROM c""")
def gated_cells(spark: SparkSession, d: str) -> DataFrame:
    """Meter tables that don't hold together have their accepted values put back to waiting."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long") % 30
    s = k % 23
    parts = F.array(*[F.struct(F.lit(n).alias("field_name"), v.cast("string").alias("value_final"), gone.alias("gone")) for n, v, gone in (("start", s, F.lit(False)), ("end", s + size, k % 13 == 0), ("total", size + (k % 7 == 0).cast("int"), F.lit(False)))])
    rows = table(spark, d, "part").select(k.cast("string").alias("page_id"), k.alias("k"), F.inline(parts))
    waits = (F.col("k") % 11 == 0) & (F.col("field_name") == "start")
    rows = rows.select(
        "page_id", F.lit("tab").alias("region"), F.lit("meter").alias("role"), F.concat_ws(":", "page_id", "field_name").alias("field_id"), "field_name", F.lit("k").alias("row_key"), F.lit("decimal").alias("format"), (~F.col("gone")).cast("int").alias("has_value_raw"),
        F.when(~F.col("gone"), F.col("value_final")).alias("value_final"), F.when(waits, "pending").otherwise("auto").alias("review_status"), F.when(waits, "pending").otherwise("auto").alias("status_raw"),
    )
    return cells.page_gate(rows).select("field_id", F.col("review_status").alias("status"), "reason")


@query(f"""
WITH {_sql('fields')}
SELECT field_id, has_value_raw = 1 AND h % 3 <> 0 OR confidence >= 0.5 AS written, CASE WHEN review_status = 'pending' AND coalesce(value_final, '') = '' THEN NULL WHEN has_value = 0 THEN 0 WHEN coalesce(value_final, '') = '' THEN NULL WHEN regexp_full_match(value_final, '[0-9]+') THEN value_final::BIGINT END AS number,
       CASE WHEN field_name = 'f2' THEN 'integers' WHEN kind = 'signature' THEN 'marks' ELSE 'null' END AS recognizer FROM fields""")
def cell_basics(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cell is written on, its whole number, and which recogniser it goes to."""
    (f,) = _get(spark, d, "fields")
    area = F.when((F.col("has_value_raw") == 1) & (F.col("h") % 3 != 0), 60)
    routed = templates.route(f, {"integer": "integers"}, {"signature": "marks"}, "null")
    return routed.select("field_id", cells.presence(area, F.col("confidence"), 0.5).alias("written"), cells.cell_int(F.col("has_value"), F.col("value_final"), F.col("review_status")).alias("number"), "recognizer")


@query("""
WITH m AS (SELECT l_orderkey AS page_id, l_linenumber AS row_no, CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS yes, CASE WHEN l_discount > 0.07 THEN 1 ELSE 0 END AS no FROM lineitem),
u AS (SELECT page_id, count(*) FILTER (yes = 0 AND no = 0) >= 0.8 * count(*) AS unused FROM m GROUP BY 1)
SELECT unused AS column_unused, yes, no, CASE WHEN unused OR yes = no THEN NULL WHEN yes > no THEN 1 ELSE 0 END AS says, count(*) AS n FROM m JOIN u USING (page_id) GROUP BY ALL""")
def unused_tick_columns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("row_no"), (F.col("l_tax") > 0.05).cast("int").alias("yes"), (F.col("l_discount") > 0.07).cast("int").alias("no"))
    return cells.unused_columns(m, ["page_id"]).groupBy("column_unused", "yes", "no", "says").agg(F.count(F.lit(1)).alias("n"))


_BLOBS = """
b AS (SELECT 'p' || p_partkey % 50 AS page_id, p_partkey AS blob_id, p_partkey * 7 % 90 AS x0, p_partkey * 13 % 40 AS y0, p_partkey * 7 % 90 + 4 + p_size AS x1, p_partkey * 13 % 40 + 6 AS y1, p_size * 3 AS ink FROM part),
c AS (SELECT 'p' || p AS page_id, 'c' || i AS cell_id, i % 5 * 20 AS cx0, i // 5 * 12 AS cy0, i % 5 * 20 + 18 AS cx1, i // 5 * 12 + 11 AS cy1 FROM range(50) t(p), range(20) u(i)),
m AS (SELECT *, greatest(0, least(x1, cx1) - greatest(x0, cx0)) * greatest(0, least(y1, cy1) - greatest(y0, cy0)) AS shared FROM b JOIN c USING (page_id)),
h AS (SELECT page_id, blob_id, count(*) AS hits, arg_min(cell_id, (-shared, cell_id)) AS best FROM m WHERE shared > 0 AND shared >= 0.3 * least((x1 - x0) * (y1 - y0), (cx1 - cx0) * (cy1 - cy0)) GROUP BY ALL),
j AS (SELECT b.*, coalesce(hits, 0) AS hits, best, x1 - x0 > 1.6 * 18 OR coalesce(hits, 0) >= 3 OR (hits IS NULL AND x1 - x0 > 18) AS note FROM b LEFT JOIN h USING (page_id, blob_id))
"""


def _blobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    b = table(spark, d, "part").select(F.concat(F.lit("p"), (k % 50).cast("string")).alias("page_id"), k.alias("blob_id"), (k * 7 % 90).alias("x0"), (k * 13 % 40).alias("y0"), (k * 7 % 90 + 4 + size).alias("x1"), (k * 13 % 40 + 6).alias("y1"), (size * 3).alias("ink"))
    i = F.col("i")
    c = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    c = c.select("page_id", F.concat(F.lit("c"), i.cast("string")).alias("cell_id"), (i % 5 * 20).alias("x0"), (F.floor(i / 5) * 12).alias("y0"), (i % 5 * 20 + 18).alias("x1"), (F.floor(i / 5) * 12 + 11).alias("y1"))
    return cells.assign_blobs(b, c, F.lit(18))


@query(f"WITH {_BLOBS} SELECT page_id, blob_id, hits, note, CASE WHEN NOT note THEN best END AS cell_id FROM j")
def writing_across_cells(spark: SparkSession, d: str) -> DataFrame:
    return _blobs(spark, d)[1]


@query(f"WITH {_BLOBS} SELECT page_id, best AS cell_id, sum(ink)::BIGINT AS ink FROM j WHERE NOT note AND best IS NOT NULL GROUP BY ALL")
def ink_by_cell(spark: SparkSession, d: str) -> DataFrame:
    return _blobs(spark, d)[0]


# --- page meta, dates, precedence ------------------------------------------------------------------------------------


@query(f"""
WITH {_sql('meta')}
SELECT page_id, meta_key, CASE WHEN machine_status IS NULL OR source IS NULL THEN 'none' WHEN machine_status IN ('auto', 'unlisted') THEN CASE WHEN machine_value IS NOT DISTINCT FROM value THEN 'match' ELSE 'mismatch' END ELSE 'unread' END AS result FROM meta""")
def meta_checked(spark: SparkSession, d: str) -> DataFrame:
    (m,) = _get(spark, d, "meta")
    return m.select("page_id", "meta_key", precedence.check(F.col("value"), F.col("source").isNotNull(), F.col("machine_value"), F.col("machine_status")).alias("result"))


@query(f"""
WITH {_sql('pages')}, s AS (SELECT *, CASE WHEN k % 7 = 0 THEN '2025-01-05' END AS pd, CASE WHEN k % 5 = 0 THEN ' 2025-02-06 ' WHEN k % 5 = 1 THEN '' END AS dd, CASE WHEN k % 4 = 0 THEN '2025-13-40' END AS pl, CASE WHEN k % 3 = 0 THEN '2025-03-07' END AS dl FROM pages)
SELECT page_id, coalesce(pd, nullif(trim(dd), ''), pl, dl, work_date) AS page_value, CASE WHEN coalesce(pd, nullif(trim(dd), '')) IS NOT NULL THEN 'decision' WHEN coalesce(pl, dl) IS NOT NULL THEN 'label' WHEN work_date IS NOT NULL THEN 'filename' END AS page_source,
       coalesce(nullif(trim(dd), ''), dl, work_date) AS document_value, CASE WHEN nullif(trim(dd), '') IS NOT NULL THEN 'decision' WHEN dl IS NOT NULL THEN 'label' WHEN work_date IS NOT NULL THEN 'filename' END AS document_source FROM s""")
def dates_by_precedence(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    k = F.col("k")
    own, whole = F.when(k % 7 == 0, "2025-01-05"), F.when(k % 5 == 0, " 2025-02-06 ").when(k % 5 == 1, "")
    label, of_doc = F.when(k % 4 == 0, "2025-13-40"), F.when(k % 3 == 0, "2025-03-07")
    page, doc = precedence.page_date(own, whole, label, of_doc, F.col("work_date")), precedence.document_date(whole, F.when(k % 4 == 0, F.coalesce(of_doc, label)).otherwise(of_doc), F.col("work_date"))
    return p.select("page_id", page["value"].alias("page_value"), page["source"].alias("page_source"), doc["value"].alias("document_value"), doc["source"].alias("document_source"))


@query(f"""
WITH {_sql('meta')}, p AS (SELECT page_id, machine_status AS status, machine_value AS machine, CASE WHEN g9 THEN NULL ELSE value END AS human FROM (SELECT *, value IS NULL AS g9 FROM meta) WHERE meta_key <> 'equipment' AND machine_status IS NOT NULL)
SELECT page_id, CASE WHEN bool_or(human IS NULL) THEN 'none' WHEN bool_or(status = 'auto' AND machine IS DISTINCT FROM human) THEN 'mismatch' WHEN bool_and(status = 'auto') THEN 'match' ELSE 'unread' END AS check_result FROM p GROUP BY 1""")
def date_parts_checked(spark: SparkSession, d: str) -> DataFrame:
    (m,) = _get(spark, d, "meta")
    return precedence.date_check(m.where("meta_key <> 'equipment'").select("page_id", F.col("value").alias("human"), F.col("machine_value").alias("machine"), F.col("machine_status").alias("status")))


@query(f"""
WITH {_sql('meta')}
SELECT page_id, meta_key, coalesce(CASE WHEN source IN ('review', 'label') THEN value END, CASE WHEN machine_status = 'auto' THEN machine_value END) AS value,
       CASE WHEN source IN ('review', 'label') THEN source ELSE 'machine' END AS source FROM meta WHERE source IN ('review', 'label') OR (machine_status = 'auto' AND machine_value IS NOT NULL)""")
def machine_meta_last(spark: SparkSession, d: str) -> DataFrame:
    """People's values before what a machine accepted."""
    (m,) = _get(spark, d, "meta")
    key = ["page_id", "meta_key"]
    people = m.where("source IN ('review', 'label')").select(*key, F.when(F.col("source") == "label", "page_label").otherwise(F.col("source")).alias("source"), "value")
    return precedence.resolve(people.unionByName(precedence.machine_candidates(m, key)), key)


@query(f"""
WITH {_sql('meta')}, r AS (SELECT field_id, page_id, meta_key, g2 % 3 AS v FROM (SELECT *, length(page_id) + length(coalesce(value, '')) AS g2 FROM meta) WHERE field_id IS NOT NULL AND meta_key = 'operator')
SELECT page_id, meta_key, 'review' AS source, CASE WHEN v = 0 THEN 'new' END AS value FROM r WHERE v < 2""")
def reviews_of_meta(spark: SparkSession, d: str) -> DataFrame:
    (m,) = _get(spark, d, "meta")
    f = m.where("field_id IS NOT NULL AND meta_key = 'operator'")
    v = (F.length("page_id") + F.length(F.coalesce("value", F.lit("")))) % 3
    reviews = f.select("field_id", F.when(v == 0, "value").when(v == 1, "empty").otherwise("illegible").alias("verdict"), F.lit("new").alias("value"), F.lit("kim").alias("reviewer"), F.lit("t").alias("reviewed_at"), F.lit(1).alias("seq"))
    return review.meta_overrides(reviews, f.select("field_id", "page_id", "meta_key").unionByName(f.select("field_id", "page_id", F.lit("date.day").alias("meta_key"))))


# --- reviews, decisions, queues --------------------------------------------------------------------------------------


@query(f"""
WITH {_sql('docs', 'pages', 'fields')}, n AS (SELECT field_id, ['value', 'empty', 'illegible', 'odd'][1 + h % 4] AS verdict, CASE h % 3 WHEN 0 THEN ' 0' || h WHEN 1 THEN 'x' ELSE '' END AS value, r, h FROM fields WHERE r IN (2, 3)),
v AS (SELECT *, CASE WHEN verdict = 'value' AND h % 3 = 0 THEN CASE WHEN r = 2 THEN h::VARCHAR ELSE regexp_replace('0' || h, '^0+([0-9])', '\\1') END END AS canon FROM n)
SELECT v.field_id, verdict, canon AS value, source_name || '#' || page_no AS source, CASE WHEN verdict = 'odd' THEN 'no such verdict' WHEN verdict = 'value' AND canon IS NULL THEN 'value doesn''t fit' END AS error,
       substr(sha256(v.field_id || '|' || verdict || '|' || coalesce(canon, '') || '|kim|t1'), 1, 16) AS review_id FROM v JOIN fields f ON f.field_id = v.field_id JOIN pages p ON p.page_id = f.page_id JOIN docs ON docs.document_id = p.document_id""")
def reviews_in_context(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f = _get(spark, d, "docs", "pages", "fields")
    h = F.col("h")
    new = f.where("r IN (2, 3)").select("field_id", F.element_at(F.array(*[F.lit(x) for x in ("value", "empty", "illegible", "odd")]), (h % 4 + 1).cast("int")).alias("verdict"), F.when(h % 3 == 0, F.concat(F.lit(" 0"), h.cast("string"))).when(h % 3 == 1, "x").otherwise("").alias("value"), F.lit("kim").alias("reviewer"), F.lit("t1").alias("reviewed_at"), F.lit(None).cast("string").alias("note"))
    return review.with_context(new, f, pages, docs).select("field_id", "verdict", "value", "source", "error", "review_id")


@query(f"""
WITH {_sql('docs')}, n AS (SELECT 'd' || k || CASE WHEN k % 3 = 0 THEN '-p' || (1 + k % 5) ELSE '' END AS target, k, ['date', 'discard', 'keep', 'odd'][1 + k % 4] AS kind, CASE WHEN k % 5 = 0 THEN '2025-02-30' ELSE '2025-02-03' END AS value, CASE WHEN k % 3 = 0 THEN 1 + k % 5 END AS page, n_pages FROM docs WHERE k % 2 = 0 OR k % 3 = 0)
SELECT target, kind, page AS page_no, CASE WHEN page > n_pages THEN 'no such page' WHEN kind = 'odd' THEN 'no such kind' WHEN kind = 'date' AND k % 5 = 0 THEN 'not a day' WHEN kind = 'keep' AND page IS NULL THEN 'only pages are kept' END AS error,
       substr(sha256(target || '|' || kind || '|' || value || '|kim|t'), 1, 16) AS decision_id FROM n""")
def decisions_checked(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = _get(spark, d, "docs")
    k = F.col("k")
    target = F.concat(F.col("document_id"), F.when(k % 3 == 0, F.concat(F.lit("-p"), (k % 5 + 1).cast("string"))).otherwise(""))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("date", "discard", "keep", "odd")]), (k % 4 + 1).cast("int"))
    b = docs.where("k % 2 = 0 OR k % 3 = 0").select(target.alias("target"), kind.alias("kind"), F.when(k % 5 == 0, "2025-02-30").otherwise("2025-02-03").alias("value"), F.lit("kim").alias("decided_by"), F.lit("t").alias("decided_at"), F.lit(None).cast("string").alias("note"))
    return review.check_decisions(b, docs).select("target", "kind", "page_no", "error", "decision_id")


@query("""
WITH e AS (SELECT 'd' || user_id AS t, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'date' ELSE 'discard' END AS kind, strftime(ts, '%Y') AS v FROM events),
a AS (SELECT t, arg_max(v, seq) FILTER (kind = 'date') AS dt, max(1) FILTER (kind = 'discard') AS x FROM e WHERE seq % 5 <> 0 GROUP BY 1), b AS (SELECT t, arg_max(v, seq) FILTER (kind = 'date') AS dt, max(1) FILTER (kind = 'discard') AS x FROM e GROUP BY 1),
c AS (SELECT b.t FROM b LEFT JOIN a ON a.t = b.t WHERE a.t IS NULL OR a.dt IS DISTINCT FROM b.dt OR a.x IS DISTINCT FROM b.x)
SELECT DISTINCT 'd' || user_id AS document_id, 1 + CASE WHEN 'd' || user_id IN (SELECT t FROM c) THEN 1 ELSE 0 END AS work_requested FROM events""")
def documents_asked_again(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("target"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "date").otherwise("discard").alias("kind"), F.date_format("ts", "yyyy").alias("value"))
    docs = e.select(F.col("target").alias("document_id"), F.lit(1).alias("work_requested")).distinct()
    return review.request(docs, review.touched_documents(e.where("seq % 5 <> 0"), e))


@query(f"""
WITH {_sql('fields')}, q AS (SELECT * FROM fields WHERE r IN (2, 3) AND h % 11 <> 0), t AS (SELECT *, row_number() OVER (PARTITION BY has_value <> 0, template_name ORDER BY sha256('s:' || field_id), field_id) AS turn FROM q),
f AS (SELECT * FROM t WHERE has_value <> 0 ORDER BY turn, template_name, sha256('s:' || field_id) LIMIT 75), e AS (SELECT * FROM t WHERE has_value = 0 ORDER BY turn, template_name, sha256('s:' || field_id) LIMIT 25)
SELECT field_id, has_value FROM f UNION ALL SELECT field_id, has_value FROM e""")
def blind_sample(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    f = f.where("r IN (2, 3)")
    return sampling.blind_sample(f, f.where("h % 11 = 0").select("field_id"), ["template_name"], "s", 100, 0.25).select("field_id", "has_value")


@query(f"""
WITH {_sql('pages', 'fields')}, q AS (SELECT f.field_id, p.template_name FROM fields f JOIN pages p USING (page_id) WHERE region = 'fields' AND review_status = 'auto' AND h % 9 <> 0 AND status = 'loaded')
SELECT field_id FROM (SELECT *, row_number() OVER (PARTITION BY template_name ORDER BY sha256('a:' || field_id), field_id) AS turn FROM q) ORDER BY turn, template_name, sha256('a:' || field_id) LIMIT 40""")
def audit_queue(spark: SparkSession, d: str) -> DataFrame:
    pages, f = _get(spark, d, "pages", "fields")
    return review.page_fields(f.drop("template_name"), pages, f.where("h % 9 = 0").select("field_id"), "a", 40, audit=True).select("field_id")


@query(f"WITH {_sql('meta', 'fields')} SELECT page_id, meta_key FROM meta WHERE field_id IS NOT NULL AND check_result = 'mismatch' AND field_id NOT IN (SELECT field_id FROM fields WHERE h % 3 = 0)")
def meta_to_check(spark: SparkSession, d: str) -> DataFrame:
    meta, f = _get(spark, d, "meta", "fields")
    return review.meta_check(meta, f.where("h % 3 = 0").select("field_id")).select("page_id", "meta_key")


@query(f"WITH {_sql('fields')} SELECT page_id, count(*) FILTER (review_status = 'pending') AS waiting, count(*) AS n, min(field_id) AS first FROM fields WHERE format <> 'integer' AND region <> 'fields' GROUP BY 1 HAVING waiting > 0")
def readings_to_review(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    return review.readings(f).select("page_id", "waiting", F.size("cells").alias("n"), F.array_min(F.transform("cells", lambda c: c["field_id"])).alias("first"))


@query(f"""
WITH {_sql('fields')}
SELECT template_name, row_number() OVER (PARTITION BY template_name ORDER BY sha256('c:' || field_id), field_id) AS turn, field_id FROM fields WHERE r = 5 AND h % 4 <> 0 QUALIFY turn <= 8""")
def checklist_queue(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    todo = sampling.queue(f, f.where("h % 4 = 0").select("field_id"), F.col("r") == 5)
    return sampling.stratified(todo, ["template_name"], "field_id", "c", None).where("turn <= 8").select("template_name", "turn", "field_id")


@query(f"""
WITH {_sql('haul')}, x AS (SELECT work_date, slot, material, level, bool_or(source_role = 'log') AND bool_or(source_role = 'matrix') AND sum(g) % 3 = 0 AS wrong, list_sort(list(DISTINCT haul_id)) AS ids FROM haul WHERE slot IS NOT NULL GROUP BY ALL)
SELECT work_date, slot, material, level, len(ids) AS n, array_to_string(ids, ' ') AS cells FROM x WHERE wrong""")
def mismatching_cells(spark: SparkSession, d: str) -> DataFrame:
    (h,) = _get(spark, d, "haul")
    key = ["work_date", "slot", "material", "level"]
    both = (F.max((F.col("source_role") == "log").cast("int")) == 1) & (F.max((F.col("source_role") == "matrix").cast("int")) == 1) & (F.sum("g") % 3 == 0)
    checks = h.where("slot IS NOT NULL").groupBy(*key).agg(F.when(both, "mismatch").otherwise("match").alias("status"))
    found = sampling.mismatch_groups(checks, h)
    return found.select(*key, F.size("cells").alias("n"), F.array_join(F.array_sort(F.transform("cells", lambda c: c["haul_id"])), " ").alias("cells"))


@query(f"""
WITH {_sql('fields')} SELECT page_id AS check_id FROM fields WHERE r IN (2, 3) GROUP BY 1 HAVING NOT bool_and(h % 3 = 0)""")
def unconfirmed_checks(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    f = f.where("r IN (2, 3)")
    reviews = f.where("h % 3 = 0").select("field_id", F.lit("usage-check: seen").alias("note")).unionByName(f.where("h % 3 = 1").select("field_id", F.lit("other").alias("note")))
    return sampling.confirmed(f.select(F.col("page_id").alias("check_id"), "field_id"), reviews, "usage-check")


@query(f"""
WITH {_sql('fields')}, j AS (SELECT *, CASE WHEN h % 4 = 0 THEN 'value' WHEN h % 4 = 1 THEN 'empty' WHEN h % 4 = 2 THEN 'illegible' END AS verdict FROM fields)
SELECT kind, count(*) AS cells, count(*) FILTER (review_status = 'pending') AS waiting, count(verdict) AS reviewed, count(*) FILTER (CASE verdict WHEN 'value' THEN value_raw = 'v' || h WHEN 'empty' THEN has_value_raw = 0 END) AS machine_was_right FROM j GROUP BY 1""")
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    h = F.col("h")
    verdict = F.when(h % 4 == 0, "value").when(h % 4 == 1, "empty").otherwise("illegible")
    reviews = f.where("h % 4 <> 3").select("field_id", verdict.alias("verdict"), F.concat(F.lit("v"), h.cast("string")).alias("value"), F.lit("t").alias("reviewed_at"), F.lit(1).alias("seq"))
    return review.progress(f, reviews)


@query(f"""
WITH {_sql('fields')}
SELECT field_id, regexp_full_match(value_raw, '[0-9]{{1,2}}[.][0-9]{{2}}') AND coalesce(try_cast(split_part(value_raw, '.', 2) AS INT) < 60, false) AND r % 2 = 1 AS ask FROM fields WHERE r IN (2, 3)""")
def dotted_to_ask(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    return f.where("r IN (2, 3)").select("field_id", review.ask_dotted(F.lit("meter"), F.when(F.col("r") == 3, "start").otherwise("total"), F.lit("reading"), F.col("value_raw")).alias("ask"))


# --- evaluation ------------------------------------------------------------------------------------------------------

@query(f"""
WITH {_sql('fields')}, a AS (SELECT DISTINCT page_id, region FROM fields WHERE r IN (2, 3) AND h % 3 <> 0),
f AS (SELECT fields.*, CASE WHEN r IN (2, 3) AND h % 3 <> 0 THEN CASE WHEN r = 2 THEN h::VARCHAR ELSE h || '.5' END ELSE '' END AS truth, CASE WHEN r = 3 AND h % 8 <> 1 THEN coalesce(value_final, '') ELSE coalesce(value_final, '') END AS got FROM fields JOIN a USING (page_id, region) WHERE kind LIKE 'handwritten%')
SELECT kind, count(*) AS n, count(*) FILTER (got = truth) AS "right", count(*) FILTER (truth <> '') AS with_value, count(*) FILTER (truth <> '' AND got = truth) AS right_value, count(*) FILTER (status_raw = 'auto') AS accepted, count(*) FILTER (status_raw = 'auto' AND coalesce(backend, '') <> 'ink') AS auto FROM f GROUP BY 1""")
def fields_against_truth(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    # a page is its own source here, so that truth belongs to one page
    f = f.select("*", F.col("page_id").alias("source"), F.lit("t").alias("template"))
    truth = F.when(F.col("r") == 2, F.col("h").cast("string")).otherwise(F.concat(F.col("h").cast("string"), F.lit(".5")))
    answers = f.where("r IN (2, 3) AND h % 3 <> 0").select("source", F.lit(None).cast("string").alias("work_date"), "template", "region", "field_name", "row_key", truth.alias("text"))
    return evaluate.field_evaluation(f, answers, ["kind"]).select("kind", "n", "right", "with_value", "right_value", "accepted", "auto")


@query(f"""
WITH {_sql('fields')}, f AS (SELECT *, CASE WHEN r = 2 THEN h::VARCHAR ELSE h || '.5' END AS truth FROM fields WHERE r IN (2, 3) AND h % 3 <> 0 AND work_date IS NOT NULL AND ('0x' || substr(sha256('s:' || work_date), 1, 8))::BIGINT / 4294967296.0 < 0.2)
SELECT count(*) AS n, round(count(*) FILTER (m = truth) / count(*)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (status_raw = 'auto') / count(*)::DOUBLE, 4) AS auto_rate,
       round(count(*) FILTER (status_raw = 'auto' AND backend <> 'ink' AND m <> truth) / nullif(count(*) FILTER (status_raw = 'auto' AND backend <> 'ink'), 0)::DOUBLE, 4) AS auto_error FROM (SELECT *, value_raw AS m FROM f)""")
def raw_fields_of_the_test_split(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    f = f.select("*", F.col("page_id").alias("source"), F.lit("t").alias("template"))
    truth = F.when(F.col("r") == 2, F.col("h").cast("string")).otherwise(F.concat(F.col("h").cast("string"), F.lit(".5")))
    answers = f.where("r IN (2, 3) AND h % 3 <> 0").select("source", F.lit(None).cast("string").alias("work_date"), "template", "region", "field_name", "row_key", truth.alias("text"))
    got = evaluate.field_evaluation(f, answers, [], final=False, only_listed=True, split=ids.split_of(F.col("work_date"), "s") == "test")
    return evaluate.corpus_rates(got).select("n", "accuracy", "auto_rate", "auto_error")


@query("""
WITH i AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey % 40 AS e, max(o_orderkey) AS k FROM orders GROUP BY ALL), j AS (SELECT *, 'r' || k % 7 AS got, 'r' || k % 5 AS want FROM i WHERE k % 3 <> 0)
SELECT count(*) AS rows, count(*) FILTER (got = want) AS "right", count(*) FILTER (got <> want)::BIGINT AS character_errors, (2 * count(*))::BIGINT AS characters, count(*) FILTER (k % 2 = 0) AS auto FROM j""")
def remarks_against_truth(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("inspection_date"), (F.col("o_custkey") % 40).cast("string").alias("equipment_id")).agg(F.max("o_orderkey").alias("k"))
    say = lambda m: F.concat(F.lit("r"), (F.col("k") % m).cast("string"))
    daily = i.select("*", say(7).alias("remark"), F.when(F.col("k") % 2 == 0, "auto").otherwise("pending").alias("review_status"))
    answers = i.where("k % 3 <> 0").select(F.col("inspection_date").alias("work_date"), F.concat(F.lit("key"), "equipment_id").alias("row_key"), say(5).alias("text"))
    machines = i.select("equipment_id", F.concat(F.lit("key"), "equipment_id").alias("equipment_key")).distinct()
    return evaluate.remark_scores(daily, machines, answers)


@query("""
WITH s AS (SELECT p_partkey AS cell_id, unnest(['a', 'b', 'c']) AS label, unnest([p_size % 7, p_partkey % 5, 3])::DOUBLE AS score FROM part), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY cell_id)) AS e FROM s)
SELECT cell_id, CASE WHEN label <> 'c' THEN label END AS label, CASE WHEN label = 'c' THEN 'reject' ELSE 'value' END AS answer, round(e / sum(e) OVER (PARTITION BY cell_id), 5) AS share FROM e QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label) = 1""")
def closed_set_answers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("label"), v.cast("double").alias("score")) for n, v in (("a", F.col("p_size") % 7), ("b", F.col("p_partkey") % 5), ("c", F.lit(3)))])))
    return evaluate.closed_set(s, "c").withColumn("share", F.round("share", 5))


@query("""
WITH s AS (SELECT p_partkey AS cell_id, unnest(['a', 'b']) AS candidate, -unnest([p_size % 7, p_partkey % 5])::DOUBLE AS ll, -(p_partkey % 3)::DOUBLE AS free FROM part), e AS (SELECT *, exp(ll - max(ll) OVER w) AS e, max(ll) OVER w AS top FROM s WINDOW w AS (PARTITION BY cell_id))
SELECT cell_id, candidate, round(e / sum(e) OVER (PARTITION BY cell_id), 5) AS share, free - top > ln(10) AS unlisted FROM e QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY ll DESC, candidate) = 1""")
def closed_list_answers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), (-(F.col("p_partkey") % 3)).cast("double").alias("free"), F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), (-v).cast("double").alias("log_likelihood")) for n, v in (("a", F.col("p_size") % 7), ("b", F.col("p_partkey") % 5))])))
    return evaluate.closed_list(s).withColumn("share", F.round("share", 5))


@query("""
WITH t AS (SELECT t AS threshold, count(*) FILTER (l_discount >= t) AS accepted, count(*) FILTER (l_discount >= t AND l_returnflag = 'R' AND l_discount < 0.06) AS errors FROM lineitem, (SELECT unnest([0.0, 0.02, 0.04, 0.05, 0.06])::DOUBLE AS t) GROUP BY 1)
SELECT * FROM t WHERE accepted >= 100 AND errors <= 0.05 * accepted ORDER BY threshold LIMIT 1""")
def chosen_threshold(spark: SparkSession, d: str) -> DataFrame:
    right = ~((F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.06))
    return evaluate.choose_threshold(evaluate.threshold_table(table(spark, d, "lineitem"), "l_discount", right, [0.0, 0.02, 0.04, 0.05, 0.06]), 0.05)


@query("SELECT l_returnflag AS truth, count(*) AS n, count(*) FILTER (l_returnflag = CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END) AS \"right\" FROM lineitem GROUP BY 1")
def accuracy_by_value(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    return evaluate.by_value(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(n == 0, "A").when(n == 1, "N").otherwise("R").alias("pred")), "truth", "pred")


@query(f"WITH {_sql('meta')} SELECT count(*) FILTER (value IS NOT NULL AND machine_value IS NOT NULL) AS \"both\", count(*) FILTER (value = machine_value) AS same, round(count(*) FILTER (value = machine_value) / count(*) FILTER (value IS NOT NULL AND machine_value IS NOT NULL)::DOUBLE, 4) AS rate FROM meta")
def rate_of_agreement(spark: SparkSession, d: str) -> DataFrame:
    (m,) = _get(spark, d, "meta")
    return evaluate.agreement_rate(m, "value", "machine_value")


@query(f"""
WITH {_sql('pages')}, p AS (SELECT *, 'o' || c % 20 AS operator, 'v' || (c + k) % 4 AS vehicle FROM pages), n AS (SELECT operator, vehicle, count(*) AS n, min(page_id) AS seen FROM p GROUP BY ALL),
u AS (SELECT operator, vehicle AS usual FROM n QUALIFY row_number() OVER (PARTITION BY operator ORDER BY n DESC, seen) = 1)
SELECT page_id FROM p JOIN u USING (operator) WHERE vehicle <> usual""")
def changed_vehicles(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    p = p.select("page_id", F.concat(F.lit("o"), (F.col("c") % 20).cast("string")).alias("operator"), F.concat(F.lit("v"), ((F.col("c") + F.col("k")) % 4).cast("string")).alias("vehicle_no"))
    return evaluate.changed_pages(p, "operator", "vehicle_no", F.col("page_id")).select("page_id")


@query(f"""
WITH {_sql('fields')}, a AS (SELECT page_id, r, h, ['yes', 'no', 'none'][1 + h % 3] AS answer FROM fields WHERE r = 5)
SELECT page_id || ':y' AS field_id, CASE WHEN answer = 'yes' THEN 'value' ELSE 'empty' END AS verdict FROM a UNION ALL SELECT page_id || ':n', CASE WHEN answer = 'no' THEN 'value' ELSE 'empty' END FROM a""")
def checklist_reviews(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    answer = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("none")), (F.col("h") % 3 + 1).cast("int"))
    a = f.where("r = 5").select(F.concat("page_id", F.lit(":y")).alias("yes_field"), F.concat("page_id", F.lit(":n")).alias("no_field"), answer.alias("answer"), F.lit("kim").alias("reviewer"), F.lit("t").alias("reviewed_at"))
    return evaluate.checklist_reviews(a).select("field_id", "verdict")


@query(f"""
WITH {_sql('fields')}, m AS (SELECT page_id, row_no, CASE WHEN h % 5 = 0 THEN 1 WHEN h % 2 = 0 THEN 0 END AS yes, CASE WHEN h % 7 = 0 THEN 1 WHEN h % 2 = 0 THEN 0 END AS no FROM fields WHERE region = 'tab')
SELECT page_id, row_no, yes, no, CASE WHEN max(greatest(coalesce(yes, -1), coalesce(no, -1))) OVER (PARTITION BY page_id) < 0 THEN 'column_unused' WHEN yes = 1 THEN 'yes' WHEN no = 1 THEN 'no' ELSE 'none' END AS answer FROM m""")
def checklist_answers(spark: SparkSession, d: str) -> DataFrame:
    (f,) = _get(spark, d, "fields")
    h = F.col("h")
    say = lambda n: F.when(h % n == 0, 1).when(h % 2 == 0, 0)
    return evaluate.check_answers(f.where("region = 'tab'").select("page_id", "row_no", say(5).alias("yes"), say(7).alias("no")))


@query("""
WITH p AS (SELECT s_suppkey AS page, s_nationkey AS n, (s_suppkey % 5)::VARCHAR AS op, (s_suppkey % 5 + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END)::VARCHAR AS top FROM supplier), s AS (SELECT c_custkey AS slot, c_nationkey AS n, (c_custkey % 7)::VARCHAR AS op FROM customer),
so AS (SELECT *, row_number() OVER (PARTITION BY n, op ORDER BY slot) AS i FROM s), a AS (SELECT page, slot FROM (SELECT *, row_number() OVER (PARTITION BY n, op ORDER BY page) AS i FROM p) JOIN so USING (n, op, i)),
b AS (SELECT page, slot FROM (SELECT page, n, top AS op, row_number() OVER (PARTITION BY n, top ORDER BY page) AS i FROM p) JOIN so USING (n, op, i))
SELECT count(*) AS pages, count(*) FILTER (a.slot IS NOT DISTINCT FROM b.slot) AS same, count(b.slot) AS resolvable FROM p LEFT JOIN a ON a.page = p.page LEFT JOIN b ON b.page = p.page""")
def slots_by_true_meta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string").alias("vehicle_no")
    pages = lambda op: table(spark, d, "supplier").select(F.col("s_nationkey").alias("work_date"), k.alias("page_id"), k.alias("o"), op.cast("string").alias("operator"), none)
    slots = table(spark, d, "customer").select(F.col("c_nationkey").alias("work_date"), F.col("c_custkey").alias("slot"), F.col("c_custkey").alias("o"), (F.col("c_custkey") % 7).cast("string").alias("operator"), none)
    return evaluate.slot_agreement(pages(k % 5), pages(k % 5 + (k % 4 == 0).cast("int")), slots, ["work_date"], ["o"])


# --- reports ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH {_sql('docs', 'pages', 'fields')}
SELECT 'documents' AS section, 'all' AS "key", count(*) AS n FROM docs UNION ALL SELECT 'documents', 'warnings', count(warning) FROM docs UNION ALL SELECT 'documents', 'waiting', count(*) FILTER (status = 'received' OR work_requested > work_done) FROM docs
UNION ALL SELECT 'documents_by_status', status, count(*) FROM docs GROUP BY 2 UNION ALL SELECT 'documents_by_date_source', coalesce(date_source, 'none'), count(*) FROM docs GROUP BY 2
UNION ALL SELECT 'pages', 'all', count(*) FROM pages UNION ALL SELECT 'pages', 'rotated', count(*) FILTER (rotation <> 0) FROM pages UNION ALL SELECT 'pages', 'near_tie', count(*) FILTER ((k + n) % 4 = 0) FROM pages
UNION ALL SELECT 'pages_by_form', template_name, count(*) FROM pages GROUP BY 2 UNION ALL SELECT 'pages_by_status', status, count(*) FROM pages GROUP BY 2
UNION ALL SELECT 'fields', 'total', count(*) FROM fields UNION ALL SELECT 'fields', 'with_value', count(*) FILTER (has_value = 1) FROM fields UNION ALL SELECT 'fields', 'pending', count(*) FILTER (review_status = 'pending') FROM fields UNION ALL SELECT 'fields', 'reviewed', count(*) FILTER (review_status = 'reviewed') FROM fields""")
def whole_report(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f = _get(spark, d, "docs", "pages", "fields")
    tie = F.when((F.col("k") + F.col("n")) % 4 == 0, 1.5).otherwise(4.0)
    pages = pages.withColumn("variant_errs", F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), tie))
    return report.summary({"doc_document": docs, "doc_page": pages, "doc_field": f})


@query(f"WITH {_sql('meta')} SELECT meta_key, coalesce(source, 'none') AS source, check_result, machine_status, count(*) AS pages FROM meta GROUP BY ALL")
def meta_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.page_meta_counts(_get(spark, d, "meta")[0])


@query(f"""
WITH {_sql('docs', 'pages')}, d AS (SELECT 'intake' AS section, unnest(['needs_date', 'waiting', 'discarded_documents']) AS "key", unnest([count(*) FILTER (status = 'needs_date'), count(*) FILTER (status = 'received' OR work_requested > work_done), count(*) FILTER (status = 'discarded')]) AS n FROM docs),
p AS (SELECT 'intake', unnest(['discarded_pages', 'blank', 'rotated', 'duplicates']), unnest([count(*) FILTER (status = 'discarded'), count(*) FILTER (status = 'blank'), count(*) FILTER (rotation <> 0), count(*) FILTER (status = 'duplicate')]) FROM pages)
SELECT * FROM (FROM d UNION ALL FROM p UNION ALL SELECT 'date_source', coalesce(date_source, 'none'), count(*) FROM docs GROUP BY 2) WHERE n > 0""")
def intake_counts(spark: SparkSession, d: str) -> DataFrame:
    docs, pages = _get(spark, d, "docs", "pages")
    return report.intake(docs, pages)


@query(f"WITH {_sql('pages')} SELECT count(*) AS pages, min(duplicate_sim) AS least, median(duplicate_sim) AS median, max(duplicate_sim) AS most FROM pages WHERE status = 'duplicate'")
def repeats_by_similarity(spark: SparkSession, d: str) -> DataFrame:
    return report.duplicate_similarity(_get(spark, d, "pages")[0])


@query(f"""
WITH {_sql('pages')}, e AS (SELECT page_id, 'm' || c % 6 AS equipment, CASE WHEN c % 5 <> 0 THEN 'id-' || CASE WHEN c % 7 = 0 THEN 'old' ELSE 'm' || c % 6 END END AS equipment_id, c % 6 <> 3 AS known, c FROM pages)
SELECT page_id FROM e WHERE equipment_id IS DISTINCT FROM CASE WHEN known THEN 'id-m' || c % 6 END""")
def stale_equipment(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    c = F.col("c")
    name = F.concat(F.lit("m"), (c % 6).cast("string"))
    rows = p.select("page_id", name.alias("equipment"), F.when(c % 5 != 0, F.concat(F.lit("id-"), F.when(c % 7 == 0, "old").otherwise(name))).alias("equipment_id"))
    aliases = spark.createDataFrame([(f"m{i}", f"m{i}") for i in range(6) if i != 3], "name string, key string")
    return report.stale_ids(rows, aliases, F.concat(F.lit("id-"), F.col("key"))).select("page_id")


@query(f"""
WITH {_sql('haul', 'meta')}, p AS (SELECT page_id, max(work_date) AS d, max(slot) AS s FROM haul WHERE source_role = 'log' GROUP BY 1 HAVING s IS NOT NULL),
ob AS (SELECT DISTINCT d, s, CASE WHEN length(s) + substr(s, 2)::INT % 2 = 2 THEN 'operator' ELSE 'vehicle' END AS how FROM p)
SELECT coalesce(source, 'none') AS source, count(*) AS pages FROM p JOIN ob USING (d, s) LEFT JOIN meta m ON m.page_id = p.page_id AND m.meta_key = CASE WHEN how = 'operator' THEN 'operator' ELSE 'vehicle_no' END GROUP BY 1""")
def log_slot_sources(spark: SparkSession, d: str) -> DataFrame:
    h, m = _get(spark, d, "haul", "meta")
    obs = h.where("source_role = 'log' AND slot IS NOT NULL").groupBy("page_id").agg(F.max("work_date").alias("work_date"), F.max("slot").alias("slot")).select("work_date", "slot").distinct()
    obs = obs.withColumn("matched_by", F.when(F.length("slot") + F.substring("slot", 2, 9).cast("int") % 2 == 2, "operator").otherwise("vehicle"))
    return report.log_slots(h, obs, m)


@query(f"""
WITH {_sql('pages')}, p AS (SELECT *, CASE WHEN template_name = 't0' THEN 'fam' WHEN template_name = 't1' THEN 'fam' END AS family, status = 'align_failed' AS failed, (k + n) % 3 = 0 AS tie FROM pages)
SELECT coalesce(family, 'a / b') AS family, CASE WHEN NOT failed THEN template_name END AS variant, count(*) FILTER (NOT failed) AS chosen, count(*) FILTER (failed) AS align_failed, count(*) FILTER (NOT failed AND tie) AS near_tie FROM p GROUP BY ALL""")
def variants_chosen(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    p = p.withColumn("variant_errs", F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.when((F.col("k") + F.col("n")) % 3 == 0, 1.5).otherwise(4.0)))
    return report.variants(p, spark.createDataFrame([("t0", "fam"), ("t1", "fam")], "template string, family string"))


@query(f"""
WITH {_sql('fields')}
SELECT format, count(*) AS read, count(*) FILTER (status_raw = 'auto' AND has_value_raw <> 0) AS auto_value, count(*) FILTER (status_raw = 'auto' AND has_value_raw = 0) AS auto_empty, count(*) FILTER (status_raw <> 'auto') AS pending,
       count(*) FILTER (regexp_full_match(value_raw, '[0-9]{{1,2}}[.][0-9]{{2}}') AND coalesce(try_cast(split_part(value_raw, '.', 2) AS INT) < 60, false)) AS dotted FROM fields WHERE r = 3 AND coalesce(backend, '') <> 'ink' GROUP BY 1""")
def formatted_cells(spark: SparkSession, d: str) -> DataFrame:
    return report.format_cells(_get(spark, d, "fields")[0])


@query(f"""
WITH {_sql('docs', 'pages')}
SELECT source_name || '#' || page_no AS source, p.page_id FROM pages p JOIN docs USING (document_id) WHERE p.status = 'loaded' AND template_name = 't1' AND classify_margin < 2 AND rotation <> 0""")
def pages_listed(spark: SparkSession, d: str) -> DataFrame:
    docs, pages = _get(spark, d, "docs", "pages")
    return report.list_pages(docs, pages, "loaded", "t1", 2.0, False, True).select("source", "page_id")


@query(f"""
WITH {_sql('docs', 'pages', 'meta')}
SELECT page_id, meta_key, m.source AS value_source, source_name FROM meta m JOIN pages USING (page_id) JOIN docs USING (document_id) WHERE check_result = 'mismatch'""")
def meta_mismatches(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, m = _get(spark, d, "docs", "pages", "meta")
    return report.meta_mismatches(m, pages, docs).select("page_id", "meta_key", "value_source", "source_name")


@query(f"WITH {_sql('docs')} SELECT document_id, status, received_at FROM docs ORDER BY received_at DESC, document_id LIMIT 50")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return report.recent(_get(spark, d, "docs")[0]).select("document_id", "status", "received_at")


# --- sheets ----------------------------------------------------------------------------------------------------------

_STATE = "CASE WHEN {a}.review_status IS NULL THEN 'value' WHEN {a}.review_status = 'pending' THEN CASE WHEN coalesce({f}.reviewed_by, '') <> '' THEN 'illegible' ELSE 'pending' END WHEN coalesce({a}.has_value, 0) <> 0 THEN 'value' ELSE 'empty' END"
_HIDDEN = "hid AS (SELECT DISTINCT m.page_id, meta_key FROM meta m JOIN fields f USING (field_id) WHERE source = 'machine' AND f.review_status = 'pending' AND coalesce(reviewed_by, '') <> '')"
_PLACED = "pp AS (SELECT p.*, source_name || '#' || page_no AS source FROM pages p JOIN docs USING (document_id))"
_HAUL = f"""
hh AS (SELECT h.*, pp.source, f.reviewed_by, {_STATE.format(a='h', f='f')} AS state, h.page_id || '' AS pid FROM haul h LEFT JOIN fields f ON f.field_id = h.source_field_id LEFT JOIN pp ON pp.page_id = h.page_id)
"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    docs, pages, f, m, h = _get(spark, d, "docs", "pages", "fields", "meta", "haul")
    return docs, sheets.day_pages(pages, docs), f, m, h, sheets.hidden_values(m, f)


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta', 'haul')}, {_HIDDEN}, {_PLACED}, {_HAUL}
SELECT work_date, source_role AS role, coalesce(slot, 'unresolved') AS slot, CASE WHEN source_role = 'matrix' OR (pid, 'vehicle_no') NOT IN (SELECT (page_id, meta_key) FROM hid) THEN vehicle_no END AS vehicle_no, material, level, shift, CASE WHEN state = 'value' THEN trips END AS trips,
       state, CASE WHEN state IN ('pending', 'illegible') THEN trips_raw::VARCHAR END AS machine, source, source_field_id AS field_id FROM hh WHERE source_role = 'log' OR has_value <> 0 OR review_status = 'pending'""")
def haul_sheets(spark: SparkSession, d: str) -> DataFrame:
    """All rows of logs, and those of matrices that have something in them."""
    docs, pages, f, m, h, hidden = _parts(spark, d)
    both = sheets.haul_sheet(h, f, pages, hidden, "log").unionByName(sheets.haul_sheet(h, f, pages, hidden, "matrix", only_marked=True))
    return both.drop("operator")


_CHECKED = "xx AS (SELECT work_date, slot, material, level, sum(trips) FILTER (source_role = 'log')::BIGINT AS log_trips, sum(trips) FILTER (source_role = 'matrix')::BIGINT AS matrix_trips, CASE WHEN sum(g) % 3 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM (SELECT *, coalesce(slot, 'unresolved:' || vehicle_no) AS s FROM haul) GROUP BY work_date, s, material, level, slot)"


def _checks(h: DataFrame) -> DataFrame:
    log = F.col("source_role") == "log"
    keyed = h.withColumn("slot", F.coalesce("slot", F.concat(F.lit("unresolved:"), "vehicle_no")))
    total = lambda side, c: F.sum(F.when(side, F.col(c)))
    return keyed.groupBy("work_date", "slot", "material", "level").agg(
        F.min("operator").alias("operator"), F.min("vehicle_no").alias("vehicle_no"), F.max(log.cast("int")).alias("log_has"), F.max((~log).cast("int")).alias("matrix_has"), total(log, "trips").alias("log_trips"), total(~log, "trips").alias("matrix_trips"), total(log, "trips_raw").alias("log_trips_raw"), total(~log, "trips_raw").alias("matrix_trips_raw"),
        F.when(F.sum("g") % 3 == 0, "mismatch").otherwise("match").alias("status"),
    )


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta', 'haul')}, {_PLACED}, {_HAUL},
kk AS (SELECT *, coalesce(slot, 'unresolved:' || vehicle_no) AS s FROM hh),
x AS (SELECT work_date, s, material, level, CASE WHEN sum(g) % 3 = 0 THEN 'mismatch' ELSE 'match' END AS status, sum(trips) FILTER (source_role = 'log')::BIGINT AS lt, sum(trips) FILTER (source_role = 'matrix')::BIGINT AS mt,
             CASE WHEN bool_or(state = 'illegible') THEN 'illegible' WHEN bool_or(state = 'pending') THEN 'pending' WHEN bool_and(state = 'empty') THEN 'empty' ELSE 'value' END AS st, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source_role = 'log')), ', '), '') AS source FROM kk GROUP BY ALL)
SELECT work_date, s AS slot, CASE WHEN s LIKE 'unresolved:%' THEN 'unresolved' ELSE s END AS shown_slot, material, level, CASE WHEN st NOT IN ('pending', 'illegible') THEN lt END AS log_trips, CASE WHEN st NOT IN ('pending', 'illegible') THEN mt END AS matrix_trips, status, st IN ('pending', 'illegible') AS provisional,
       CASE WHEN st IN ('pending', 'illegible') THEN st ELSE 'value' END AS state, source FROM x""")
def crosscheck_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    none = m.limit(0).select("page_id", "value")
    got = sheets.crosscheck_sheet(_checks(h), h, f, pages, hidden, none)
    return got.select("work_date", "slot", "shown_slot", "material", "level", "log_trips", "matrix_trips", "status", "provisional", "state", "source")


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta', 'haul')}, {_HIDDEN}, {_PLACED}, ob AS (SELECT work_date, slot, min(operator) AS operator FROM haul WHERE slot IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT h.work_date, h.slot, h.page_id, source FROM haul h JOIN pp USING (page_id) WHERE source_role = 'log' AND h.slot IS NOT NULL),
g AS (SELECT work_date, slot, array_to_string(list_sort(list(DISTINCT source)), ', ') AS source, bool_or((page_id, 'operator') IN (SELECT (page_id, meta_key) FROM hid)) AS h FROM l GROUP BY ALL)
SELECT work_date, slot, CASE WHEN NOT coalesce(h, false) THEN operator END AS operator, coalesce(source, '') AS source FROM ob LEFT JOIN g USING (work_date, slot)""")
def assignment_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    obs = h.where("slot IS NOT NULL").groupBy("work_date", "slot").agg(F.min("operator").alias("operator"), F.min("vehicle_no").alias("vehicle_no"), F.lit(None).cast("string").alias("header_vehicle_no"), F.lit(None).cast("string").alias("header_operator"), F.lit("operator").alias("matched_by"), F.lit(0).alias("header_mismatch"))
    return sheets.assignment_sheet(obs, h, pages, hidden).select("work_date", "slot", "operator", "source")


_USAGE = """
us AS (SELECT page_id, work_date, page_id || ':tab:f2:0' AS s, page_id || ':tab:f3:1' AS e, CASE WHEN k % 2 = 0 THEN page_id || ':tab:f9:0' END AS t, (k % 50)::DOUBLE AS ms, (k % 50 + 8)::DOUBLE AS me, ['meter', 'total', NULL][1 + k % 3] AS basis FROM pages WHERE status = 'loaded')
"""


def _usage(pages: DataFrame) -> DataFrame:
    k, none = F.col("k"), lambda n, t="string": F.lit(None).cast(t).alias(n)
    fid = lambda s: F.concat("page_id", F.lit(s))
    return pages.where("status = 'loaded'").select(
        "page_id", "work_date", F.col("template_name").alias("source_form"), F.concat(F.lit("e"), (k % 9).cast("string")).alias("equipment"), none("equipment_id"), none("operator"), F.lit("meter").alias("reading_kind"), (k % 50).cast("double").alias("meter_start"), (k % 50 + 8).cast("double").alias("meter_end"), none("meter_total", "double"),
        none("clock_start"), none("clock_end"), (k % 50).cast("string").alias("meter_start_raw"), none("meter_end_raw"), none("meter_total_raw"), none("shifts", "map<string,string>"), none("shift_minutes", "long"), none("activity_rows", "long"), none("signed", "int"), F.lit(8.0).alias("hours"),
        F.element_at(F.array(F.lit("meter"), F.lit("total"), F.lit(None).cast("string")), (k % 3 + 1).cast("int")).alias("hours_basis"), fid(":tab:f2:0").alias("start_field_id"), fid(":tab:f3:1").alias("end_field_id"), F.when(k % 2 == 0, fid(":tab:f9:0")).alias("total_field_id"), F.lit("auto").alias("review_status"), "k",
    )


_FSTATE = f"fs AS (SELECT field_id, {_STATE.format(a='f', f='f')} AS st FROM fields f)"


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta')}, {_USAGE}, {_FSTATE},
j AS (SELECT us.*, coalesce(a.st, 'pending') AS sa, coalesce(b.st, 'pending') AS sb, CASE WHEN t IS NULL THEN 'value' ELSE 'pending' END AS sc, t IS NOT NULL AS has_t FROM us LEFT JOIN fs a ON a.field_id = s LEFT JOIN fs b ON b.field_id = e),
k AS (SELECT *, CASE WHEN basis IS NULL THEN 'value' ELSE CASE WHEN 'illegible' IN (sa, sb) THEN 'illegible' WHEN 'pending' IN (sa, sb) OR (basis = 'total' AND sc = 'pending') THEN 'pending' ELSE 'value' END END AS sh,
             CASE WHEN 'illegible' IN (sa, sb) THEN 'illegible' WHEN 'pending' IN (sa, sb) OR has_t THEN 'pending' WHEN sa = 'empty' AND sb = 'empty' THEN 'empty' ELSE 'value' END AS state FROM j)
SELECT page_id AS field_page, CASE WHEN sa IN ('value', 'empty') THEN ms END AS meter_start, CASE WHEN sb IN ('value', 'empty') THEN me END AS meter_end, CASE WHEN sh IN ('value', 'empty') THEN 8.0::DOUBLE END AS hours, state FROM k""")
def usage_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    got = sheets.usage_sheet(_usage(pages), f, f.limit(0), pages, hidden)
    return got.select(F.substring_index("field_id", ":", 1).alias("field_page"), "meter_start", "meter_end", "hours", "state")


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta')}, {_HIDDEN}, {_PLACED}, t AS (SELECT field_id AS tally_id, page_id, f.has_value, f.review_status, f.reviewed_by, h, {_STATE.format(a='f', f='f')} AS state FROM fields f WHERE r = 2)
SELECT tally_id, CASE WHEN (page_id, 'equipment') NOT IN (SELECT (page_id, meta_key) FROM hid) THEN 'eq' END AS equipment, CASE WHEN state = 'value' THEN h END AS "count", state, source FROM t JOIN pp USING (page_id) WHERE has_value <> 0 OR review_status = 'pending'""")
def tally_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    text = lambda n, v=None: F.lit(v).cast("string").alias(n)
    t = f.where("r = 2").select(F.col("field_id").alias("tally_id"), "page_id", "work_date", text("source_form", "t"), text("equipment", "eq"), text("item"), text("place"), text("column_name"), text("shift"), F.lit(0).alias("is_subtotal"), "has_value", F.col("h").alias("count"), F.col("h").alias("count_raw"), "review_status", F.col("field_id").alias("source_field_id"))
    return sheets.tally_sheet(t, f, pages, hidden, only_marked=True).select(F.col("field_id").alias("tally_id"), "equipment", "count", "state", "source")


_UCHECKS = "uc AS (SELECT page_id, work_date, k, ['continuity', 'total', 'subtotal'][1 + k % 3] AS kind, ['match', 'gap', 'unknown', 'mismatch'][1 + k % 4] AS result, (k % 50)::DOUBLE AS a FROM pages WHERE status = 'loaded')"


def _usage_checks(pages: DataFrame) -> DataFrame:
    k = F.col("k")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return pages.where("status = 'loaded'").select(
        "page_id", pick("continuity", "total", "subtotal").alias("check_kind"), F.lit("").alias("item"), "work_date", F.lit("ref").alias("equipment_ref"), (k % 50).cast("double").alias("value_a"), F.lit(1.0).alias("value_b"), F.lit(0.0).alias("diff"), F.lit(0).alias("days_between"), pick("match", "gap", "unknown", "mismatch").alias("result"), F.lit(None).cast("string").alias("other_page_id"),
        F.concat("page_id", F.lit(":tab:f2:0")).alias("field_a"), F.concat("page_id", F.lit(":tab:f3:1")).alias("field_b"),
    )


def _compared(pages: DataFrame, f: DataFrame, spark: SparkSession) -> DataFrame:
    pairs = spark.createDataFrame([(f"t{i}", "tab", 0, "f2", 1, "f3") for i in range(4)], "template string, region string, row_no int, column string, part_row int, part_column string")
    return handlers.check_cells(_usage_checks(pages), _usage(pages), f, pages, pairs)


@query(f"""
WITH {_sql('pages', 'fields')}, {_UCHECKS}
SELECT page_id, kind AS check_kind, '' AS item, page_id || unnest(CASE WHEN kind = 'total' AND k % 2 = 0 THEN [':tab:f2:0', ':tab:f3:1', ':tab:f9:0'] ELSE [':tab:f2:0', ':tab:f3:1'] END) AS field_id FROM uc""")
def cells_of_checks(spark: SparkSession, d: str) -> DataFrame:
    pages, f = _get(spark, d, "pages", "fields")
    return _compared(pages, f, spark)


@query(f"""
WITH {_sql('docs', 'pages', 'fields')}, {_PLACED}, {_UCHECKS}, {_FSTATE},
c AS (SELECT page_id, k, kind, result, a, unnest(CASE WHEN kind = 'total' AND k % 2 = 0 THEN [':tab:f2:0', ':tab:f3:1', ':tab:f9:0'] ELSE [':tab:f2:0', ':tab:f3:1'] END) AS x FROM uc),
w AS (SELECT page_id, kind, result, a, CASE WHEN bool_or(st = 'illegible') THEN 'illegible' WHEN bool_or(coalesce(st, 'pending') = 'pending') THEN 'pending' WHEN bool_and(st = 'empty') THEN 'empty' ELSE 'value' END AS state FROM c LEFT JOIN fs ON fs.field_id = c.page_id || x GROUP BY ALL)
SELECT page_id || ':tab:f2:0' AS field_id, kind AS check_kind, result, CASE WHEN state = 'value' THEN a END AS value_a, state IN ('pending', 'illegible') AND result NOT IN ('first', 'unknown') AS provisional, state NOT IN ('pending', 'illegible') AND result IN ('mismatch', 'gap', 'overlap') AS marked,
       CASE WHEN state IN ('pending', 'illegible') THEN state ELSE 'value' END AS state, source FROM w JOIN pp USING (page_id)""")
def usage_check_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    got = sheets.usage_check_sheet(_usage_checks(pages), _compared(pages, f, spark), f, _usage(pages), pages, hidden)
    return got.select("field_id", "check_kind", "result", "value_a", "provisional", "marked", "state", "source")


@query(f"""
WITH {_sql('docs', 'pages', 'fields')}, {_PLACED}, {_FSTATE}, i AS (SELECT page_id, 'q' || k % 30 AS e, k, source FROM pp WHERE status = 'loaded'),
j AS (SELECT i.*, CASE WHEN k % 3 = 0 AND a.st IS NOT NULL THEN 'empty' ELSE coalesce(a.st, 'pending') END AS s1, coalesce(b.st, 'pending') AS s2, coalesce(c.st, 'pending') AS sr FROM i LEFT JOIN fs a ON a.field_id = page_id || ':tab:f5:1' LEFT JOIN fs b ON b.field_id = page_id || ':tab:f4:0' LEFT JOIN fs c ON c.field_id = page_id || ':fields:f1:-1'),
w AS (SELECT *, CASE WHEN 'illegible' IN (s1, s2) THEN 'illegible' WHEN 'pending' IN (s1, s2) THEN 'pending' WHEN s1 = 'empty' AND s2 = 'empty' THEN 'empty' ELSE 'value' END AS sm FROM j)
SELECT page_id || ':fields:f1:-1' AS field_id, CASE WHEN k % 2 = 0 THEN 'H' || k % 30 ELSE e END AS machine_id, CASE WHEN sm IN ('value', 'empty') THEN k % 2 END AS abnormal, CASE WHEN sr = 'value' THEN 'rem' END AS remark, CASE WHEN 'illegible' IN (sm, sr) THEN 'illegible' WHEN 'pending' IN (sm, sr) THEN 'pending' ELSE 'value' END AS state, source FROM w""")
def inspection_sheet(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    k = F.col("k")
    p = pages.where("status = 'loaded'")
    daily = p.select(F.col("page_id").alias("inspection_id"), F.col("work_date").alias("inspection_date"), F.concat(F.lit("q"), (k % 30).cast("string")).alias("equipment_id"), (k % 2).alias("abnormal"), F.lit("rem").alias("remark"), "page_id", F.concat("page_id", F.lit(":fields:f1:-1")).alias("source_field_id"), F.lit("auto").alias("review_status"))
    machines = spark.createDataFrame([(f"q{i}", f"H{i}") for i in range(0, 30, 2)], "equipment_id string, hid string")
    marks = p.select(F.col("page_id").alias("inspection_id"), F.inline(F.array(F.struct(F.concat("page_id", F.lit(":tab:f5:1")).alias("field_id"), F.when(k % 3 == 0, "empty").alias("override")), F.struct(F.concat("page_id", F.lit(":tab:f4:0")).alias("field_id"), F.lit(None).cast("string").alias("override")))))
    return sheets.inspection_sheet(daily, machines, pages, marks, f).select("field_id", "machine_id", "abnormal", "remark", "state", "source")


_LAYOUT = [("tab", 1, 0, "f2"), ("tab", 1, 1, "f3"), ("tab", 0, 0, "f4"), ("fields", 0, -1, "f1"), ("tab", 1, 0, "f8")]


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    rows = [(f"t{t}", "one" if t < 2 else f"t{t}", no, region, row, f"k{row}", i, name, "operator" if name == "f1" else None) for t in range(4) for i, (region, no, row, name) in enumerate(_LAYOUT)]
    layout = spark.createDataFrame(rows, "template string, family string, region_no int, region string, row_no int, row_key string, idx int, field_name string, meta_key string")
    return sheets.form_blocks(pages, layout, f, m, hidden)


_BLOCK_SQL = f"""
ly AS (SELECT * FROM (VALUES ('tab', 0, 'f2'), ('tab', 1, 'f3'), ('tab', 0, 'f4'), ('fields', -1, 'f1'), ('tab', 0, 'f8')) v(region, row_no, field_name)),
bl AS (SELECT p.page_id, p.work_date, CASE WHEN p.template_name IN ('t0', 't1') THEN 'one' ELSE p.template_name END AS family, p.page_id || ':' || ly.region || ':' || ly.field_name || ':' || ly.row_no AS field_id, ly.field_name FROM pages p, ly WHERE status = 'loaded'),
bs AS (SELECT bl.*, f.value_final, CASE WHEN m.value IS NOT NULL AND h.page_id IS NULL THEN m.value END AS mv, f.kind, f.review_status, f.reviewed_by, f.has_value FROM bl LEFT JOIN fields f USING (field_id) LEFT JOIN meta m ON m.page_id = bl.page_id AND m.meta_key = 'operator' AND bl.field_name = 'f1' LEFT JOIN hid h ON h.page_id = bl.page_id AND h.meta_key = 'operator' AND bl.field_name = 'f1'),
bt AS (SELECT *, CASE WHEN kind IS NULL THEN 'none' WHEN mv IS NOT NULL THEN 'meta' WHEN review_status = 'pending' THEN CASE WHEN coalesce(reviewed_by, '') <> '' THEN 'illegible' ELSE 'pending' END WHEN has_value = 0 THEN 'empty' WHEN coalesce(value_final, '') <> '' THEN 'value' ELSE 'present' END AS state FROM bs)
"""


@query(f"WITH {_sql('pages', 'fields', 'meta')}, {_HIDDEN}, {_BLOCK_SQL} SELECT page_id, family, field_name, state, CASE state WHEN 'meta' THEN mv WHEN 'value' THEN value_final END AS value FROM bt")
def form_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("page_id", "family", "field_name", "state", "value")


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta', 'haul')}, {_HIDDEN}, {_PLACED}, {_HAUL},
kk AS (SELECT page_id, row_number() OVER (PARTITION BY work_date ORDER BY rel, parts, document_id, page_no, page_id) AS kth FROM (SELECT DISTINCT h.work_date, h.page_id, p.document_id, p.page_no, CASE WHEN coalesce(source_rel, '') <> '' AND source_rel LIKE 'intake/%' THEN 1 ELSE 0 END AS rel, list_filter(string_split(CASE WHEN coalesce(source_rel, '') <> '' THEN source_rel ELSE source_path END, '/'), lambda x: x <> '') AS parts FROM haul h JOIN pages p USING (page_id) JOIN docs USING (document_id) WHERE h.source_role = 'log' AND h.slot IS NULL)),
b AS (SELECT hh.work_date, coalesce(slot, 'unresolved ' || kth) AS block, shift, material || '|' || level AS item, count(*) AS n, any_value(state) AS state, any_value(trips) AS trips FROM hh LEFT JOIN kk USING (page_id) WHERE source_role = 'log' GROUP BY ALL),
l AS (SELECT work_date, block, shift, bool_and(n = 1 AND state IN ('value', 'empty') AND (state = 'empty' OR trips IS NOT NULL)) AS ok, sum(trips) FILTER (n = 1 AND state = 'value') AS total FROM b GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT work_date FROM haul), (SELECT DISTINCT slot AS block FROM haul WHERE slot IS NOT NULL), (SELECT DISTINCT shift FROM haul WHERE source_role = 'log')),
e AS (FROM g UNION SELECT work_date, block, shift FROM l), t AS (SELECT DISTINCT work_date, slot AS block FROM haul WHERE source_role = 'log' AND slot IS NOT NULL), u AS (SELECT DISTINCT work_date FROM haul WHERE source_role = 'log' AND slot IS NULL)
SELECT e.work_date, e.block, e.shift, CASE WHEN e.block LIKE 'unresolved %' OR t.block IS NOT NULL THEN 'log' WHEN u.work_date IS NOT NULL THEN 'unknown' ELSE 'no_document' END AS line, CASE WHEN ok THEN coalesce(total, 0) END::BIGINT AS total
FROM e LEFT JOIN l USING (work_date, block, shift) LEFT JOIN t ON t.work_date = e.work_date AND t.block = e.block LEFT JOIN u ON u.work_date = e.work_date""")
def haul_month(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    h = sheets.matched(h, f.select(F.col("field_id").alias("source_field_id"), "reviewed_by"), "source_field_id", "left")
    got = sheets.haul_table(h, pages, h.select("work_date"), _checks(h))
    return got.select("work_date", "block", "shift", "line", "total")


@query(f"""
WITH {_sql('docs', 'pages', 'fields', 'meta', 'haul')}, {_HIDDEN}, {_BLOCK_SQL}, {_UCHECKS}, pe AS (SELECT work_date, family, count(*) FILTER (state IN ('pending', 'illegible')) AS n FROM bt GROUP BY ALL),
dw AS (SELECT DISTINCT document_id, work_date FROM (SELECT document_id, work_date FROM docs WHERE status = 'received' OR work_requested > work_done UNION ALL SELECT p.document_id, p.work_date FROM pages p JOIN docs USING (document_id) WHERE docs.status = 'received' OR work_requested > work_done) WHERE work_date IS NOT NULL),
a AS (SELECT work_date, 'pages' AS section, status AS "key", count(*) AS n FROM pages GROUP BY ALL UNION ALL SELECT work_date, 'pages', 'all', count(*) FROM pages GROUP BY ALL
      UNION ALL SELECT work_date, 'forms', CASE WHEN template_name IN ('t0', 't1') THEN 'one' ELSE template_name END, count(*) FROM pages WHERE status = 'loaded' GROUP BY ALL
      UNION ALL SELECT work_date, 'pending', family, sum(n) FROM pe GROUP BY ALL UNION ALL SELECT work_date, 'pending', 'all', sum(n) FROM pe GROUP BY ALL
      UNION ALL SELECT work_date, 'usage', kind || '.' || result, count(*) FROM uc GROUP BY ALL UNION ALL SELECT work_date, 'waiting', 'documents', count(*) FROM dw GROUP BY ALL)
SELECT substr(work_date, 1, 7) AS period, section, "key", sum(n)::BIGINT AS n FROM a WHERE work_date IS NOT NULL GROUP BY ALL""")
def monthly_summaries(spark: SparkSession, d: str) -> DataFrame:
    docs, pages, f, m, h, hidden = _parts(spark, d)
    families = spark.createDataFrame([(f"t{t}", "one" if t < 2 else f"t{t}") for t in range(4)], "template string, family string")
    none = _checks(h).limit(0)
    return sheets.summary(lambda day: F.substring(day, 1, 7), pages, families, sheets.pending_cells(_blocks(spark, d)), none, _usage_checks(pages), sheets.waiting_documents(docs, pages))


@query(f"""
WITH {_sql('pages', 'haul')}, {_UCHECKS}, p AS (SELECT work_date, count(*) AS pages, count(*) FILTER (status <> 'loaded') AS not_loaded FROM pages WHERE work_date IS NOT NULL GROUP BY 1), u AS (SELECT work_date, count(*) AS n FROM uc WHERE result IN ('mismatch', 'gap', 'overlap') GROUP BY 1),
x AS (SELECT work_date, count(DISTINCT page_id) AS n FROM haul WHERE source_role = 'log' AND slot IS NULL GROUP BY 1)
SELECT work_date, pages, not_loaded, coalesce(u.n, 0) AS usage_wrong, coalesce(x.n, 0) AS unresolved FROM p LEFT JOIN u USING (work_date) LEFT JOIN x USING (work_date)""")
def days_of_months(spark: SparkSession, d: str) -> DataFrame:
    pages, h = _get(spark, d, "pages", "haul")
    pending = pages.select("work_date", F.lit("f").alias("family"), F.lit(0).alias("n"))
    got = sheets.month_days(pages.where("work_date IS NOT NULL"), pending, h, _checks(h), _usage_checks(pages))
    return got.select("work_date", "pages", "not_loaded", "usage_wrong", "unresolved")


@query(f"""
WITH {_sql('fields', 'meta')}
SELECT m.page_id, meta_key, CASE WHEN NOT coalesce(m.source = 'machine' AND f.review_status = 'pending' AND coalesce(reviewed_by, '') <> '', false) THEN m.value END AS shown FROM meta m LEFT JOIN fields f USING (field_id)""")
def meta_shown(spark: SparkSession, d: str) -> DataFrame:
    f, m = _get(spark, d, "fields", "meta")
    return export.hidden_meta(m, f).select("page_id", "meta_key", "shown")


@query(f"WITH {_sql('haul')} SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'm1|l1' THEN 0 WHEN 'm0|l2' THEN 1 ELSE 2 END, name)::INTEGER AS place FROM (SELECT DISTINCT material || '|' || level AS name FROM haul)")
def columns_in_order(spark: SparkSession, d: str) -> DataFrame:
    (h,) = _get(spark, d, "haul")
    return export.ordered_names(h.select(F.concat_ws("|", "material", "level").alias("name")), "name", ["m1|l1", "m0|l2", "gone"])


# --- handlers --------------------------------------------------------------------------------------------------------

_CAT = [(f"t{t}", "tab", "k0", "f2", "log" if t < 2 else "matrix", f"m{t}", "l0", "day", f"s{t}", f"v{t}", f"o{t}") for t in range(4)]


@query(f"""
WITH {_sql('pages', 'fields', 'meta')}, v AS (SELECT page_id, max(value) FILTER (meta_key = 'vehicle_no') AS vn FROM meta GROUP BY 1)
SELECT field_id AS haul_id, f.work_date, CASE WHEN p.template_name IN ('t0', 't1') THEN 'log' ELSE 'matrix' END AS source_role, CASE WHEN p.template_name IN ('t2', 't3') THEN 's' || substr(p.template_name, 2) END AS slot, CASE WHEN p.template_name IN ('t0', 't1') THEN vn ELSE 'v' || substr(p.template_name, 2) END AS vehicle_no,
       'm' || substr(p.template_name, 2) AS material, f.has_value, CASE WHEN regexp_full_match(value_final, '[0-9]+') THEN value_final::BIGINT END AS trips, CASE WHEN regexp_full_match(value_raw, '[0-9]+') THEN value_raw::BIGINT END AS trips_raw, review_status
FROM fields f JOIN pages p USING (page_id) LEFT JOIN v USING (page_id) WHERE f.field_name = 'f2' AND f.row_key = 'k0'""")
def haul_of_fields(spark: SparkSession, d: str) -> DataFrame:
    pages, f, m = _get(spark, d, "pages", "fields", "meta")
    catalog = spark.createDataFrame(_CAT, "template string, region string, row_key string, field_name string, role string, material string, level string, shift string, slot string, vehicle_no string, operator string")
    got = handlers.load("haul", f.drop("work_date", "template_name"), catalog, pages, m)["prod_haul"]
    return got.select("haul_id", "work_date", "source_role", "slot", "vehicle_no", "material", "has_value", "trips", "trips_raw", "review_status")


@query(f"""
WITH {_sql('pages', 'haul')} SELECT DISTINCT work_date FROM (SELECT work_date FROM pages WHERE status = 'blank' UNION ALL SELECT work_date FROM haul WHERE g % 5 = 0 UNION ALL SELECT work_date FROM haul WHERE slot IS NULL) WHERE work_date IS NOT NULL""")
def days_to_check(spark: SparkSession, d: str) -> DataFrame:
    pages, h = _get(spark, d, "pages", "haul")
    return handlers.check_days(pages.where("status = 'blank'"), h.where("g % 5 = 0"), h.where("slot IS NULL"))


@query(f"""
WITH {_sql('pages')}, p AS (SELECT *, 'f' || k % 3 AS family FROM pages WHERE work_date IS NOT NULL), me AS (SELECT DISTINCT document_id AS b, work_date, family, k AS bk FROM p WHERE k % 10 = 0),
held AS (SELECT b, bk, document_id, k FROM p JOIN me USING (work_date, family) WHERE status = 'duplicate'),
sim AS (SELECT me2.b, me2.bk, q.document_id, q.k FROM (SELECT DISTINCT b, bk FROM me) me2 JOIN p o ON o.document_id = me2.b JOIN p q ON q.page_no = o.page_no AND q.k = o.k + 3 AND q.status = 'loaded' AND q.k % 7 <> 0)
SELECT DISTINCT document_id FROM (FROM held UNION ALL FROM sim) WHERE k > bk""")
def documents_asked_later(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    p = p.where("work_date IS NOT NULL").withColumn("family", F.concat(F.lit("f"), (F.col("k") % 3).cast("string")))
    near = p.select("page_id", F.concat(F.lit("d"), (F.col("k") - 3).cast("string"), F.lit("-p"), F.col("n").cast("string")).alias("other_page_id"))
    return handlers.ask_later(p.where("k % 10 = 0").select("document_id", "work_date", "family"), p, near, p.where("k % 7 = 0").select("page_id"), p.select("document_id", F.col("k").alias("place")).distinct())


@query(f"""
WITH {_sql('pages')} SELECT page_id, row_number() OVER (PARTITION BY work_date ORDER BY document_id, page_no) AS turn FROM pages""")
def pages_in_turn(spark: SparkSession, d: str) -> DataFrame:
    return handlers.pick_order(_get(spark, d, "pages")[0]).select("page_id", "turn")


@query(f"""
WITH {_sql('pages', 'fields')}, {_UCHECKS}, ch AS (SELECT page_id FROM pages WHERE k % 9 = 0) SELECT DISTINCT work_date FROM pages WHERE k % 9 = 0 AND work_date IS NOT NULL""")
def changed_days(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _get(spark, d, "pages")
    rows = p.select("page_id", "work_date", "status")
    return handlers.changed_scopes(rows, p.select("page_id", "work_date", F.when(F.col("k") % 9 == 0, "other").otherwise(F.col("status")).alias("status")), ["page_id"], "work_date")


@query("""
WITH e AS (SELECT event_id::VARCHAR AS page_id, strftime(ts, '%Y-%m-%d') AS work_date, floor(value) AS s, floor(value) + event_id % 5 AS e, (event_id % 5 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::DOUBLE AS t FROM events)
SELECT 'total' AS check_kind, CASE WHEN abs(t - (e - s)) <= 0.05 THEN 'match' ELSE 'mismatch' END AS result, count(*) AS n FROM e GROUP BY ALL""")
def usage_rechecked(spark: SparkSession, d: str) -> DataFrame:
    """All checks anew, counted; of these rows the totals (continuity has a query of its own)."""
    i = F.col("event_id")
    u = table(spark, d, "events").select(
        i.cast("string").alias("page_id"), F.date_format("ts", "yyyy-MM-dd").alias("work_date"), F.col("user_id").cast("string").alias("equipment_id"), F.lit(None).cast("string").alias("equipment"), F.lit("meter").alias("reading_kind"), F.floor("value").cast("double").alias("meter_start"),
        (F.floor("value") + i % 5).cast("double").alias("meter_end"), (i % 5 + (i % 4 == 0).cast("int")).cast("double").alias("meter_total"),
    )
    pages = u.select("page_id", F.col("page_id").alias("document_id"), F.lit(1).alias("page_no"))
    docs = u.select(F.col("page_id").alias("document_id"), F.col("page_id").alias("source_name"))
    tally = spark.createDataFrame([], "page_id string, template string, region string, row_no int, column string, field_id string, has_value int, number long")
    pairs = spark.createDataFrame([], "template string, region string, row_no int, column string, part_row int, part_column string")
    return handlers.check_summary(handlers.recheck(u, pages, docs, tally, pairs)).where("check_kind = 'total'")
