"""Queries on sources that must agree, on what wins, and on what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import cells, continuity, diff, duplicates, evaluate, export, latest, precedence, reconcile, sampling, templates, usage
from ..sources.files import table
from ..sources.scratch import new_path
from ..streaming import worker
from .catalog import query


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


_SIDES = """
s AS (SELECT l_returnflag AS f, l_suppkey AS slot, strftime(l_shipdate, '%Y-%m') AS month,
             CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS BIGINT) END AS q, CASE WHEN l_discount <> 0 THEN CAST(l_quantity AS BIGINT) END AS qr
      FROM lineitem WHERE l_returnflag IN ('A', 'R')),
g AS (SELECT f, slot, month, CASE WHEN count(*) = count(q) THEN sum(q)::BIGINT END AS q, CASE WHEN count(*) = count(qr) THEN sum(qr)::BIGINT END AS qr FROM s GROUP BY ALL),
j AS (SELECT coalesce(a.slot, r.slot) AS slot, coalesce(a.month, r.month) AS month, a.slot IS NOT NULL AS l, r.slot IS NOT NULL AS m,
             a.q AS log_trips, r.q AS matrix_trips, a.qr AS log_trips_raw, r.qr AS matrix_trips_raw
      FROM (FROM g WHERE f = 'A') a FULL OUTER JOIN (FROM g WHERE f = 'R') r ON a.slot = r.slot AND a.month = r.month),
x AS (SELECT slot, month, CASE WHEN l THEN 1 WHEN m AND h.slot2 IS NOT NULL THEN 0 END AS log_has, CASE WHEN m THEN 1 END AS matrix_has,
             log_trips, matrix_trips, log_trips_raw, matrix_trips_raw,
             CASE WHEN NOT l AND h.slot2 IS NULL THEN 'missing_log' WHEN NOT m THEN 'missing_matrix'
                  WHEN l AND coalesce(log_trips = matrix_trips, true) THEN 'match' ELSE 'mismatch' END AS status
      FROM j LEFT JOIN (SELECT DISTINCT slot AS slot2 FROM g WHERE f = 'A') h ON h.slot2 = j.slot)
"""


@query(f"WITH {_SIDES} SELECT * FROM x")
def reconcile_two_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    known = lambda c: F.when(F.col(c) != 0, F.col("l_quantity").cast("long"))
    rows = rows.select("l_returnflag", F.col("l_suppkey").alias("slot"), _month("l_shipdate").alias("month"), F.lit(1).alias("has_value"), F.lit(1).alias("has_value_raw"), known("l_tax").alias("trips"), known("l_discount").alias("trips_raw"))
    side = lambda f: reconcile.collect(rows.where(F.col("l_returnflag") == f), ["slot", "month"])
    return reconcile.compare(side("A"), side("R"), ["slot"], ["month"])


@query(f"WITH {_SIDES} SELECT status, count(*) AS n FROM x GROUP BY status")
def reconcile_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile_two_sources(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SIDES} SELECT count(*) FILTER (log_trips IS NOT NULL AND matrix_trips IS NOT NULL) AS \"both\", count(*) FILTER (log_trips = matrix_trips) AS same FROM x")
def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.agreement(reconcile_two_sources(spark, d), "log_trips", "matrix_trips")


@query("""
WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - cents AS diff_cents,
       CASE WHEN abs(CAST(round(o_totalprice * 100) AS BIGINT) - cents) <= 5 THEN 'match' ELSE 'mismatch' END AS result
FROM orders JOIN l ON l_orderkey = o_orderkey""")
def order_total_check(spark: SparkSession, d: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("cents"))
    j = table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("total")).join(lines, "o_orderkey")
    diff_cents = F.col("total") - F.col("cents")
    return j.select("o_orderkey", diff_cents.alias("diff_cents"), F.when(F.abs(diff_cents) <= 5, "match").otherwise("mismatch").alias("result"))


@query("""
WITH c AS (SELECT l_suppkey, l_linestatus AS col, l_returnflag AS r, CASE WHEN count(*) FILTER (l_tax = 0 AND l_discount = 0) = 0 THEN sum(CAST(l_quantity AS BIGINT)) END AS q,
                  sum(CAST(l_quantity AS BIGINT)) AS known FROM lineitem GROUP BY ALL),
h AS (SELECT l_suppkey, col, sum(known) AS k, sum(q) AS s, count(*) = count(q) AS ok FROM c GROUP BY l_suppkey, col),
g AS (SELECT *, k - CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS got FROM h)
SELECT l_suppkey::VARCHAR AS page_id, 'subtotal' AS check_kind, l_suppkey || ':3:' || col AS item, got::BIGINT AS value_a, CASE WHEN ok THEN s END::BIGINT AS value_b,
       CASE WHEN ok THEN got - s END::BIGINT AS diff, CASE WHEN NOT ok THEN 'unknown' WHEN got = s THEN 'match' ELSE 'mismatch' END AS result FROM g""")
def subtotal_check(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    by = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("column"), "l_returnflag")
    parts = by.agg(F.when(F.count_if((F.col("l_tax") == 0) & (F.col("l_discount") == 0)) == 0, F.sum(q)).alias("number"), F.sum(q).alias("known"))
    parts = parts.withColumn("row_no", F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")).cast("int") - 1)
    claims = parts.groupBy("l_suppkey", "column").agg(F.sum("known").alias("known")).select("l_suppkey", "column", (F.col("known") - (F.col("l_suppkey") % 3 == 0).cast("int")).alias("number"), F.lit(3).alias("row_no"))
    rows = parts.select("l_suppkey", "column", "number", "row_no").unionByName(claims)
    rows = rows.select(F.col("l_suppkey").cast("string").alias("page_id"), F.lit("t").alias("template"), F.lit("r").alias("region"), "row_no", "column", F.concat_ws(":", "l_suppkey", "row_no", "column").alias("field_id"), F.lit(1).alias("has_value"), "number")
    grid = spark.range(4).select(F.col("id").cast("int").alias("row_no")).select("row_no", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("column"), F.lit("t").alias("template"), F.lit("r").alias("region"), (F.col("row_no") == 3).alias("row_subtotal"), F.lit(False).alias("column_subtotal"))
    return continuity.subtotal_check(rows, continuity.subtotal_pairs(grid))


_RECORDS = """
r AS (SELECT event_id::VARCHAR AS page_id, CASE WHEN event_id % 89 <> 0 THEN 'id:' || user_id END AS ref, CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS work_date,
             event_type AS source_name, event_id % 10 AS page_no, CASE WHEN event_id % 11 = 0 THEN 'pending' WHEN event_id % 7 = 0 THEN 'clock' ELSE 'meter' END AS kind,
             CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN floor(value) END AS s, CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 THEN floor(value) + event_id % 3 END AS e
      FROM events)
"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    meter = (i % 11 != 0) & (i % 7 != 0)
    kind = F.when(i % 11 == 0, "pending").when(i % 7 == 0, "clock").otherwise("meter")
    return table(spark, d, "events").select(
        i.cast("string").alias("page_id"), ids.equipment_ref(F.when(i % 89 != 0, F.col("user_id").cast("string")), F.lit(None)).alias("ref"), F.when(i % 97 != 0, _day("ts")).alias("work_date"), F.col("event_type").alias("source_name"), (i % 10).alias("page_no"), kind.alias("reading_kind"),
        F.when(meter, F.floor("value").cast("double")).alias("meter_start"), F.when(meter & (i % 5 != 0), (F.floor("value") + i % 3).cast("double")).alias("meter_end"),
    )


@query(f"""
WITH {_RECORDS},
d AS (SELECT *, last_value(CASE WHEN e IS NOT NULL OR s IS NOT NULL OR kind = 'pending' THEN {{'p': page_id, 'd': work_date, 'e': e}} END IGNORE NULLS)
                OVER (PARTITION BY ref ORDER BY work_date, s IS NULL, s, source_name, page_no, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
             count(*) FILTER (s IS NULL AND kind = 'pending') OVER (PARTITION BY ref, work_date) AS unplaced
      FROM r WHERE ref IS NOT NULL AND work_date IS NOT NULL),
a AS (SELECT * FROM d UNION ALL BY NAME SELECT *, NULL AS prev, 0 AS unplaced FROM r WHERE ref IS NULL OR work_date IS NULL),
k AS (SELECT *, CASE WHEN ref IS NULL OR work_date IS NULL OR s IS NULL OR unplaced > 0 OR (prev IS NOT NULL AND prev.e IS NULL) THEN 'unknown' WHEN prev IS NULL THEN 'first'
                     WHEN abs(s - prev.e) <= 0.05 THEN 'match' WHEN s > prev.e THEN 'gap' ELSE 'overlap' END AS result FROM a WHERE s IS NOT NULL OR kind = 'pending')
SELECT page_id, 'continuity' AS check_kind, work_date, ref AS equipment_ref, s AS value_a, CASE WHEN result IN ('match', 'gap', 'overlap') THEN prev.e END AS value_b,
       CASE WHEN result IN ('match', 'gap', 'overlap') THEN s - prev.e END AS diff, CASE WHEN result IN ('match', 'gap', 'overlap') THEN greatest(0, date_diff('day', prev.d::DATE, work_date::DATE) - 1)::INTEGER END AS days_between,
       result, CASE WHEN result IN ('match', 'gap', 'overlap') THEN prev.p END AS other_page_id FROM k""")
def meter_continuity(spark: SparkSession, d: str) -> DataFrame:
    return continuity.continuity(_records(spark, d))


@query("""
WITH e AS (SELECT event_id, floor(value) AS s, floor(value) + event_id % 5 AS e, event_id % 5 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS t FROM events)
SELECT event_id::VARCHAR AS page_id, 'total' AS check_kind, t::DOUBLE AS value_a, (e - s)::DOUBLE AS value_b, (t - (e - s))::DOUBLE AS diff, CASE WHEN abs(t - (e - s)) <= 0.05 THEN 'match' ELSE 'mismatch' END AS result FROM e""")
def total_check(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    u = table(spark, d, "events").select(i.cast("string").alias("page_id"), F.lit(None).cast("string").alias("work_date"), F.floor("value").cast("double").alias("meter_start"), (F.floor("value") + i % 5).cast("double").alias("meter_end"), (i % 5 + (i % 4 == 0).cast("int")).cast("double").alias("meter_total"))
    return continuity.total_check(u).drop("work_date")


@query("""
WITH p AS (SELECT s_suppkey AS page, s_nationkey AS n, floor(s_acctbal / 1000)::BIGINT::VARCHAR AS op, (s_suppkey % 7)::VARCHAR AS v FROM supplier),
s AS (SELECT c_custkey AS slot, c_nationkey AS n, floor(c_acctbal / 1000)::BIGINT::VARCHAR AS op, (c_custkey % 7)::VARCHAR AS v FROM customer),
m1 AS (SELECT n, page, slot FROM (SELECT *, row_number() OVER (PARTITION BY n, op ORDER BY page) AS i FROM p) JOIN (SELECT *, row_number() OVER (PARTITION BY n, op ORDER BY slot) AS i FROM s) USING (n, op, i)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY n, v ORDER BY page) AS i FROM p WHERE page NOT IN (SELECT page FROM m1)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY n, v ORDER BY slot) AS i FROM s WHERE slot NOT IN (SELECT slot FROM m1))
SELECT n AS work_date, page AS page_id, slot, 'operator' AS matched_by FROM m1 UNION ALL SELECT n, page, slot, 'vehicle' FROM p2 JOIN s2 USING (n, v, i)""")
def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t, p, name: table(spark, d, t).select(F.col(f"{p}_nationkey").alias("work_date"), F.col(name).alias("k"), F.floor(F.col(f"{p}_acctbal") / 1000).cast("string").alias("operator"), (F.col(name) % 7).cast("string").alias("vehicle_no"))
    pages = side("supplier", "s", "s_suppkey").withColumnRenamed("k", "page_id")
    slots = side("customer", "c", "c_custkey").withColumnRenamed("k", "slot")
    return reconcile.assign_slots(pages, slots, ["work_date"], ["page_id"], ["slot"])


_HAUL_SQL = """
h AS (SELECT strftime(l_shipdate, '%Y-%m') AS d, l_returnflag = 'R' AS m, 'p' || l_orderkey % 40 AS page, (l_suppkey % 15)::VARCHAR AS slot, CASE WHEN l_returnflag = 'R' THEN l_suppkey % 15 % 12 ELSE l_orderkey % 40 % 12 END::VARCHAR AS op,
             CASE WHEN l_returnflag = 'R' THEN l_suppkey % 15 % 9 ELSE l_orderkey % 40 % 9 END::VARCHAR AS v, l_linestatus AS material, l_linenumber::VARCHAR AS level, CASE WHEN l_tax <> 0 THEN l_quantity::BIGINT END AS q,
             lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem WHERE l_returnflag IN ('A', 'R')),
p AS (SELECT d, page, op, v, min(id) AS o FROM h WHERE NOT m GROUP BY ALL), s AS (SELECT d, slot, op, v, min(id) AS o FROM h WHERE m GROUP BY ALL),
m1 AS (SELECT d, page, slot, 'operator' AS how FROM (SELECT *, row_number() OVER (PARTITION BY d, op ORDER BY o) AS i FROM p) a JOIN (SELECT d, slot, op, row_number() OVER (PARTITION BY d, op ORDER BY o) AS i FROM s) b USING (d, op, i)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY d, v ORDER BY o) AS i FROM p WHERE (d, page) NOT IN (SELECT (d, page) FROM m1)), s2 AS (SELECT *, row_number() OVER (PARTITION BY d, v ORDER BY o) AS i FROM s WHERE (d, slot) NOT IN (SELECT (d, slot) FROM m1)),
mm AS (FROM m1 UNION ALL SELECT p2.d, page, slot, 'vehicle' FROM p2 JOIN s2 ON p2.d = s2.d AND p2.v = s2.v AND p2.i = s2.i),
"""


@query(f"""
WITH {_HAUL_SQL}
l AS (SELECT h.d, coalesce(mm.slot, 'unresolved:' || h.v) AS slot, material, level, CASE WHEN count(*) = count(q) THEN sum(q)::BIGINT END AS q FROM h LEFT JOIN mm ON mm.d = h.d AND mm.page = h.page WHERE NOT m GROUP BY ALL),
x AS (SELECT d, slot, material, level, CASE WHEN count(*) = count(q) THEN sum(q)::BIGINT END AS q FROM h WHERE m GROUP BY ALL),
j AS (SELECT coalesce(l.d, x.d) AS d, coalesce(l.slot, x.slot) AS slot, coalesce(l.material, x.material) AS material, coalesce(l.level, x.level) AS level, l.d IS NOT NULL AS a, x.d IS NOT NULL AS b, l.q AS log_trips, x.q AS matrix_trips
      FROM l FULL OUTER JOIN x ON l.d = x.d AND l.slot = x.slot AND l.material = x.material AND l.level = x.level)
SELECT d AS work_date, slot, material, level, log_trips, matrix_trips, CASE WHEN NOT a AND (d, slot) NOT IN (SELECT (d, slot) FROM l) THEN 'missing_log' WHEN NOT b THEN 'missing_matrix' WHEN a AND coalesce(log_trips = matrix_trips, true) THEN 'match' ELSE 'mismatch' END AS status FROM j""")
def haul_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.crosscheck(_haul(spark, d))[0].select("work_date", "slot", "material", "level", "log_trips", "matrix_trips", "status")


@query(f"WITH {_HAUL_SQL} z AS (SELECT 1) SELECT mm.d AS work_date, mm.slot, mm.how AS matched_by, p.op AS operator, s.op AS header_operator, (p.op <> s.op OR p.v <> s.v)::INTEGER AS header_mismatch FROM mm JOIN p ON p.d = mm.d AND p.page = mm.page JOIN s ON s.d = mm.d AND s.slot = mm.slot")
def assignments(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.crosscheck(_haul(spark, d))[1].select("work_date", "slot", "matched_by", "operator", "header_operator", "header_mismatch")


def _haul(spark: SparkSession, d: str) -> DataFrame:
    c, matrix = F.col, F.col("l_returnflag") == "R"
    page, slot = c("l_orderkey") % 40, c("l_suppkey") % 15
    who = lambda n: F.when(matrix, slot % n).otherwise(page % n).cast("string")
    trips = F.when(c("l_tax") != 0, c("l_quantity").cast("long"))
    return table(spark, d, "lineitem").where(c("l_returnflag").isin("A", "R")).select(
        F.concat_ws("-", F.lpad(c("l_orderkey").cast("string"), 9, "0"), "l_linenumber", "l_partkey", "l_suppkey").alias("haul_id"), _month("l_shipdate").alias("work_date"), F.when(matrix, "matrix").otherwise("log").alias("source_role"),
        F.concat(F.lit("p"), page.cast("string")).alias("page_id"), F.when(matrix, slot.cast("string")).alias("slot"), who(9).alias("vehicle_no"), who(12).alias("operator"), c("l_linestatus").alias("material"), c("l_linenumber").cast("string").alias("level"),
        F.lit(1).alias("has_value"), F.lit(1).alias("has_value_raw"), trips.alias("trips"), trips.alias("trips_raw"),
    )


@query("SELECT * FROM (SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return latest.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""
WITH e AS (SELECT user_id::VARCHAR AS target, event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'discard' WHEN 2 THEN 'restore' ELSE 'keep' END AS kind FROM events)
SELECT target, arg_max(event_type, event_id) FILTER (kind = 'date') AS "date", coalesce(arg_max(CASE WHEN kind = 'discard' THEN 1 ELSE 0 END, event_id) FILTER (kind IN ('discard', 'restore')), 0) AS discarded,
       coalesce(max(1) FILTER (kind = 'keep'), 0) AS keep FROM e GROUP BY target""")
def grouped_decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("date"), F.lit("discard"), F.lit("restore"), F.lit("keep")), (F.col("event_id") % 4 + 1).cast("int"))
    return latest.effective_decisions(table(spark, d, "events").select(F.col("user_id").cast("string").alias("target"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("value")))


@query("""
WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS v, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS x FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS field_id, CASE v WHEN 'F' THEN x WHEN 'O' THEN '' ELSE c_mktsegment END AS value_final, CASE v WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE c_custkey % 2 END AS has_value,
       CASE WHEN v IN ('F', 'O') THEN 'reviewed' WHEN v IS NOT NULL THEN 'pending' ELSE 'auto' END AS review_status FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def reviews_applied(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("field_id"), F.col("c_mktsegment").alias("value_final"), (F.col("c_custkey") % 2).alias("has_value"), F.lit("auto").alias("review_status"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"))
    verdict = F.when(F.col("o_orderstatus") == "F", "value").when(F.col("o_orderstatus") == "O", "empty").otherwise("illegible")
    reviews = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("field_id"), verdict.alias("verdict"), F.col("o_orderpriority").alias("value"), F.lit("r").alias("reviewer"), F.col("o_orderdate").cast("timestamp_ntz").alias("reviewed_at"), F.col("o_orderkey").alias("seq"))
    return latest.apply_reviews(fields, reviews).drop("reviewed_by", "reviewed_at")


@query("""
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN lang ELSE source END AS value,
       CASE WHEN quality IS NOT NULL THEN 'review' WHEN d.doc_id % 3 = 0 THEN 'label' ELSE 'machine' END AS source
FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR CASE WHEN d.doc_id % 3 = 0 THEN lang ELSE source END IS NOT NULL""")
def precedence_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    is_ = lambda s, v: [F.lit(s).alias("source"), v.alias("value")]
    review = table(spark, d, "labels").join(docs.select("doc_id"), "doc_id").where("quality IS NOT NULL").select("doc_id", *is_("review", F.when(F.col("quality") == 1, "good")))
    label = docs.where("doc_id % 3 = 0").select("doc_id", *is_("document_label", F.col("lang")))
    machine = docs.select("doc_id", *is_("machine", F.col("source")))
    return precedence.resolve(review.unionByName(label).unionByName(machine), ["doc_id"])


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS \"day\", max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1, 2")
def winner_last_in_order(spark: SparkSession, d: str) -> DataFrame:
    return latest.latest(table(spark, d, "orders").select("o_custkey", _day("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus"), ["o_custkey", "day"], ["o_orderkey"])


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS document_id, min(doc_id) OVER w AS \"first\", count(*) OVER w AS copies, doc_id <> min(doc_id) OVER w AS is_copy FROM documents WINDOW w AS (PARTITION BY substr(sha256(text), 1, 16))")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_copies(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id").drop("text")


@query("""
WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
s AS (SELECT DISTINCT label, 0::BIGINT AS i, []::STRUCT(id BIGINT, e DOUBLE[])[] AS kept, NULL::BIGINT AS page, NULL::BIGINT AS dup, NULL::DOUBLE AS sim FROM o
      UNION ALL
      SELECT label, i, CASE WHEN -best.n >= 0.3 THEN kept ELSE list_append(kept, {'id': vec_id, 'e': e}) END, vec_id, CASE WHEN -best.n >= 0.3 THEN best.id END, CASE WHEN -best.n >= 0.3 THEN -best.n END
      FROM (SELECT s.label, o.i, s.kept, o.vec_id, o.e, list_sort([{'n': -list_cosine_similarity(k.e, o.e), 'id': k.id} FOR k IN s.kept])[1] AS best FROM s JOIN o ON o.label = s.label AND o.i = s.i + 1))
SELECT page::VARCHAR AS page_id, dup::VARCHAR AS duplicate_of, round(sim, 6) AS similarity FROM s WHERE dup IS NOT NULL""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "embeddings").select("label", "vec_id", "embedding", F.col("vec_id").cast("string").alias("page_id"))
    return duplicates.hold_repeats(pages, ["label"], "vec_id", "embedding", threshold=0.3).withColumn("similarity", F.round("similarity", 6))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def waiting_exists(spark: SparkSession, d: str) -> DataFrame:
    waiting = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(waiting, "c_custkey", "left_semi")


@query("""
WITH t(template, valid_from, valid_to) AS (VALUES ('t1', NULL, '1994-06-30'), ('t2', '1994-07-01', '1997-12-31'), ('t3', '1996-01-01', NULL))
SELECT template, count(*) AS orders FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) JOIN t ON (valid_from IS NULL OR valid_from <= d) AND (valid_to IS NULL OR d <= valid_to) GROUP BY 1""")
def template_validity(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("t1", None, "1994-06-30"), ("t2", "1994-07-01", "1997-12-31"), ("t3", "1996-01-01", None)], "template string, valid_from string, valid_to string")
    return templates.templates_for(table(spark, d, "orders").select(_day("o_orderdate").alias("work_date")), t).groupBy("template").agg(F.count(F.lit(1)).alias("orders"))


@query("""
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer)
SELECT l_orderkey, l_linenumber, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS text FROM lineitem LEFT JOIN a ON a.k = l_orderkey LEFT JOIN b ON b.k = l_suppkey""")
def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("text"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("l_suppkey"), F.col("c_mktsegment").alias("text"))
    return precedence.fallback(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), a, b, ["l_orderkey"], ["l_suppkey"], "text").select("l_orderkey", "l_linenumber", "text")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders
UNION ALL SELECT -1 - c_custkey, 'N', c_custkey FROM customer WHERE c_custkey % 10 = 0""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    changed = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_custkey", F.lit(0).cast("long"))
    new = table(spark, d, "customer").where("c_custkey % 10 = 0").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_custkey").alias("o_custkey"))
    return diff.upsert(old, changed.unionByName(new), ["o_orderkey"], ["o_custkey"])


_SCOPE_SQL = """
r AS (SELECT o_custkey, o_orderkey, sha256('bigint:' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || 'string:' || length(o_orderstatus) || ':' || o_orderstatus || 'bigint:' || length(c::VARCHAR) || ':' || c) AS h
      FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)),
"""


def _scope_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


_QUARTERS = " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT)::VARCHAR" for i in range(4))


@query(f"WITH {_SCOPE_SQL} x AS (SELECT 1) SELECT o_custkey, count(*) AS rows, sha256(count(*) || '|' || {_QUARTERS}) AS fingerprint FROM r GROUP BY 1")
def fingerprint_scopes(spark: SparkSession, d: str) -> DataFrame:
    return diff.scope_fingerprints(_scope_rows(spark, d), ["o_custkey"], ["o_orderkey", "o_orderstatus", "cents"])


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS ch FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1),
k AS (SELECT o_custkey, bool_or(o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) AS added, bool_or(o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0) AS gone FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'remove' ELSE 'replace' END AS action FROM k LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_custkey) WHERE added OR gone""")
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    rows, cols = _scope_rows(spark, d), ["o_orderkey", "o_orderstatus", "cents"]
    before, after = (diff.scope_fingerprints(rows.where(c), ["o_custkey"], cols) for c in ("o_orderkey % 7 <> 0", "o_orderkey % 11 <> 0"))
    return diff.plan_publish(after, before, ["o_custkey"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders
WHERE (o_orderkey % 7 = 0) <> (o_orderkey % 11 = 0) OR (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0)""")
def row_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    after = rows.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")))
    return diff.row_changes(rows.where("o_orderkey % 7 <> 0"), after, ["o_orderkey"])


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS k, o_orderkey % 2 AS h, count(*)::DOUBLE AS v FROM orders GROUP BY ALL), a AS (FROM m WHERE h = 0), b AS (FROM m WHERE h = 1)
SELECT coalesce(a.k, b.k) AS "key", a.v AS "before", b.v AS "after", CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR abs(a.v - b.v) > 0.01""")
def dict_diff_tolerance(spark: SparkSession, d: str) -> DataFrame:
    half = lambda h: table(spark, d, "orders").where(F.col("o_orderkey") % 2 == h).groupBy(_month("o_orderdate").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return diff.flat_diff(half(0), half(1), ["key"])


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS "month", count(*) AS n, sum(CASE WHEN o_orderkey % 100 = 1 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END = 'F')::BIGINT AS f FROM orders GROUP BY 1""")
def dirty_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Counts by month, computed anew only for months with a changed order."""
    before = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", _month("o_orderdate").alias("month"))
    after = before.withColumn("o_orderstatus", F.when((F.col("o_orderkey") % 100 == 1) & (F.col("o_orderstatus") == "O"), "F").otherwise(F.col("o_orderstatus")))
    count = lambda df: df.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    dirty = diff.dirty_keys(diff.row_changes(before, after, ["o_orderkey"]), before, after, ["o_orderkey"], ["month"])
    return diff.recompute(count(before), dirty, count(after.join(dirty, "month", "left_semi")), ["month"])


@query("""
WITH f AS (SELECT l_orderkey, max(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS document_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN coalesce(p, 0) = 1 OR o_orderpriority = '1-URGENT' THEN 'needs_review' ELSE 'processed' END AS status
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    docs = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("processed").alias("status"))
    pages = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-p1")).alias("page_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "error").otherwise("loaded").alias("status"))
    fields = table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-p1")).alias("page_id"), F.when(F.col("l_tax") == 0, "pending").otherwise("auto").alias("review_status"))
    return usage.document_status(docs, pages, fields)


@query("""
WITH c AS (SELECT strftime(l_shipdate, '%Y-%m') AS d, l_suppkey::VARCHAR AS e, l_orderkey % 9 AS o, (l_orderkey % 9)::VARCHAR AS p, max(CASE WHEN l_linenumber % 3 = 1 THEN (l_discount > 0.05)::INTEGER END) AS y, max(CASE WHEN l_linenumber % 3 = 2 THEN (l_tax > 0.03)::INTEGER END) AS n,
                  max(CASE WHEN l_linenumber % 3 = 0 THEN 1 END) AS hr, max(CASE WHEN l_linenumber % 3 = 0 THEN (l_quantity > 20)::INTEGER END) AS rv, max(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END) AS r,
                  max(CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey || ':' || l_linenumber END) AS f, max(l_linestatus = 'O' AND l_tax = 0) AS pend FROM lineitem GROUP BY ALL HAVING y IS NOT NULL AND n IS NOT NULL),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY d, e ORDER BY o DESC) = 1),
a AS (SELECT *, CASE WHEN y = 1 THEN 1 WHEN n = 1 THEN 0 END AS ab FROM w)
SELECT d || ':' || e AS inspection_id, d AS inspection_date, e AS equipment_id, p AS page_id, ab AS abnormal, r AS remark, f AS source_field_id,
       CASE WHEN pend OR hr IS NULL OR coalesce(ab = 1 AND coalesce(rv, 0) = 0, false) THEN 'pending' ELSE 'auto' END AS review_status, 'scan' AS entry_source FROM a""")
def inspection_daily(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    has = F.when(n == 1, (F.col("l_discount") > 0.05).cast("int")).when(n == 2, (F.col("l_tax") > 0.03).cast("int")).otherwise((F.col("l_quantity") > 20).cast("int"))
    rows = table(spark, d, "lineitem").select(
        _month("l_shipdate").alias("work_date"), F.col("l_suppkey").cast("string").alias("equipment_id"), (F.col("l_orderkey") % 9).alias("o"), (F.col("l_orderkey") % 9).cast("string").alias("page_id"), F.when(n == 1, "yes").when(n == 2, "no").otherwise("remark").alias("cell"), has.alias("has_value"),
        F.col("l_returnflag").alias("value_final"), F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0), "pending").otherwise("auto").alias("review_status"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("field_id"),
    )
    return usage.inspection_rows(rows, "o")


@query("""
WITH c AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS work_date, l_suppkey AS slot, l_returnflag || '|' || l_linestatus AS item, count(*) AS n, any_value(CAST(l_quantity AS BIGINT)) AS q, any_value(l_tax = 0) AS z, any_value(l_discount = 0) AS e FROM lineitem GROUP BY ALL)
SELECT work_date, slot, CASE WHEN bool_or(n > 1 OR z) THEN NULL ELSE coalesce(sum(CASE WHEN NOT e THEN q END), 0) END::BIGINT AS total FROM c GROUP BY 1, 2""")
def haul_lines(spark: SparkSession, d: str) -> DataFrame:
    """Totals of lines whose cells are all sure: waiting ones (no tax here) and overlaps make a line unsure."""
    h = table(spark, d, "lineitem").select(F.lit("log").alias("source_role"), _day("l_shipdate").alias("work_date"), F.lit(None).cast("string").alias("shift"), F.col("l_suppkey").alias("slot"), F.col("l_returnflag").alias("material"), F.col("l_linestatus").alias("level"), F.col("l_quantity").cast("long").alias("trips"), "l_tax", "l_discount")
    state = cells.row_state(F.when(F.col("l_tax") == 0, "pending").otherwise("auto"), F.lit(None).cast("string"), (F.col("l_discount") != 0).cast("int"))
    return export.haul_lines(export.haul_cells(h, state)).drop("shift")


@query("""
SELECT * FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s1:' || doc_id), doc_id)::INTEGER AS turn FROM documents) ORDER BY turn, lang LIMIT 60""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "s1", 60)


@query("SELECT user_id, event_type, count(*) AS n, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_events_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts from a stream of the events' file, which must be those of the table."""
    place = new_path(spark, "events-stream")
    stream = worker.file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")
    # each round appends its own partial counts; a round that is repeated overwrites them
    add = lambda batch, n: worker.running_counts(batch, ["user_id", "event_type"]).write.mode("overwrite").parquet(f"{place}/rounds/round={n}")
    worker.run_rounds(stream, add, f"{place}/checkpoint").awaitTermination()
    rounds = spark.read.parquet(f"{place}/rounds")
    return rounds.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
