"""Queries that count, pivot and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, evaluate, export, latest, report, sampling
from ..sources.files import table
from .catalog import query


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


@query("""
SELECT 'orders_by_status' AS section, coalesce(o_orderstatus, 'unknown') AS "key", count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'orders', 'all', count(*) FROM orders UNION ALL SELECT 'orders', 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'orders', 'large', count(*) FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'lines_by_flag', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), F.col
    return report.counts(o, "orders_by_status", c("o_orderstatus")).unionByName(report.totals(o, "orders", all=F.lit(True), urgent=c("o_orderpriority") == "1-URGENT", large=c("o_totalprice") > 200000)).unionByName(report.counts(table(spark, d, "lineitem"), "lines_by_flag", c("l_returnflag")))


@query("""
SELECT l_returnflag AS template, strftime(l_shipdate, '%Y-%m') AS "month", count(*) AS pages, count(*) FILTER (l_linestatus = 'F') AS loaded, count(*) FILTER (l_linestatus = 'O') AS align_failed, 0 AS error, 0 AS classified_only,
       min(l_quantity::BIGINT) AS min_inliers, count(*) FILTER (l_discount * 20 < 1.5) AS low_margin, round(list_sort(list(l_tax))[count(*) // 2 + 1], 2) AS grid_err_median, round(max(l_tax), 2) AS grid_err_max FROM lineitem GROUP BY 1, 2""")
def report_by_month(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "loaded").otherwise("align_failed")
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("template_name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("work_date"), status.alias("status"), F.col("l_quantity").cast("long").alias("align_inliers"), F.col("l_tax").alias("align_grid_err"), (F.col("l_discount") * 20).alias("classify_margin"))
    return report.by_month(p)


@query("SELECT l_suppkey, list_sort(list(l_quantity::BIGINT))[count(*) // 2 + 1] AS upper_median, median(l_quantity)::DOUBLE AS true_median, min(l_quantity)::BIGINT AS least, max(l_quantity)::BIGINT AS most FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    upper = report.upper_medians(rows, ["l_suppkey"], "q").withColumnRenamed("q", "upper_median")
    rest = rows.groupBy("l_suppkey").agg(F.median("q").alias("true_median"), F.min("q").alias("least"), F.max("q").alias("most"))
    return upper.join(rest, "l_suppkey")


@query("SELECT l_returnflag AS backend, count(*) AS fields, count(*) FILTER (l_tax > 0) AS auto, count(*) FILTER (l_linestatus = 'O') AS pending, count(*) FILTER (l_linestatus = 'F') AS reviewed FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 10, "handwritten_number").otherwise("printed").alias("kind"), F.col("l_returnflag").alias("backend"), F.when(F.col("l_tax") > 0, "auto").otherwise("pending").alias("status_raw"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("reviewed").alias("review_status"))
    return report.by_backend(f)


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS days FROM orders GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("days"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS \"month\", count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def pivot_by_date(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(table(spark, d, "lineitem").select(_month("l_shipdate").alias("month"), "l_returnflag"), "month", "l_returnflag", ["A", "N", "R"])


@query("SELECT quality::VARCHAR AS truth, count(*) FILTER (n_chars > 1000) AS \"1\", count(*) FILTER (n_chars <= 1000) AS \"0\" FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.confusion(j.select(F.col("quality").cast("string").alias("truth"), (F.col("n_chars") > 1000).cast("int").cast("string").alias("pred")), "truth", "pred", ["1", "0"])


@query("SELECT t AS threshold, count(*) FILTER (l_discount >= t) AS accepted, count(*) FILTER (l_discount >= t AND l_returnflag = 'R') AS errors FROM lineitem, (SELECT unnest([0.0, 0.02, 0.05, 0.08, 0.1])::DOUBLE AS t) GROUP BY 1")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_table(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") != "R", [0.0, 0.02, 0.05, 0.08, 0.1])


@query("SELECT least(floor(l_discount * 100 + 0.5)::INT, 9) AS bin, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS \"right\" FROM lineitem GROUP BY 1")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("c", (F.floor(F.col("l_discount") * 100 + 0.5) / 10 + 0.05))
    return evaluate.calibration_bins(lines, "c", F.col("l_returnflag") == "A").drop("mean_confidence")


@query("SELECT count(*) FILTER (l_tax > 0 AND l_discount > 0) AS \"both\", count(*) FILTER (l_tax <= 0 AND l_discount > 0) AS only_machine, count(*) FILTER (l_tax > 0 AND l_discount <= 0) AS only_truth, count(*) FILTER (l_tax <= 0 AND l_discount <= 0) AS neither FROM lineitem")
def presence_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.presence_scores(table(spark, d, "lineitem"), F.col("l_tax") > 0, F.col("l_discount") > 0)


@query("SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part WHERE p_brand <> p_type GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20")
def top_k_confusions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_pairs(table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")), "a", "b", 20)


@query("SELECT value, count(*) AS n FROM (SELECT p_brand AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return sampling.candidate_values(p.select(F.col("p_brand").alias("value")), p.select(F.col("p_type").alias("value")), table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")))


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""")
def mode_usual(spark: SparkSession, d: str) -> DataFrame:
    return latest.mode(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", F.col("event_id"))


@query("SELECT DISTINCT k FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    b = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    return a.union(b).distinct().join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("""
WITH d AS (SELECT o_orderkey, 1 + o_orderkey % 9 AS n FROM orders), e AS (SELECT o_orderkey, unnest(generate_series(1, n)) AS page_no FROM d)
SELECT e.o_orderkey::VARCHAR AS document_id, e.page_no::INTEGER AS page_no, count(l_orderkey) AS lines FROM e LEFT JOIN lineitem ON l_orderkey = e.o_orderkey AND l_linenumber = page_no GROUP BY 1, 2""")
def page_slots(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), (1 + F.col("o_orderkey") % 9).alias("n_pages"))
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page_no")).agg(F.count(F.lit(1)).alias("lines"))
    return report.page_slots(docs, pages).na.fill(0, ["lines"])


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS "month", count(*) AS orders, count(DISTINCT o_custkey) AS customers, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1""")
def monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(_month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""
WITH c AS (SELECT l_suppkey AS slot, strftime(l_shipdate, '%Y-%m') AS work_date, l_returnflag AS material, l_linestatus AS level, bool_or(l_tax = 0) AS provisional FROM lineitem GROUP BY ALL)
SELECT * FROM c""")
def provisional_checks(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slot"), _month("l_shipdate").alias("work_date"), F.col("l_returnflag").alias("material"), F.col("l_linestatus").alias("level"), "l_tax")
    return export.provisional(h.drop("l_tax").distinct(), h, F.col("l_tax") == 0)


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_tax = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "lineitem").withColumn("field_id", F.col("l_orderkey")).withColumn("review_status", F.when(F.col("l_tax") == 0, "pending").otherwise("auto"))
    reviews = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("field_id"))
    return sampling.queue(fields, reviews).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""
SELECT 'doc_page' AS "table", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING n > 0
UNION ALL SELECT 'prod_haul', count(*) FROM events WHERE event_id % 50 = 0 HAVING count(*) > 0""")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("page_id"), F.col("l_orderkey").alias("document_id"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"))
    haul = table(spark, d, "events").select(F.when(F.col("event_id") % 50 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("work_date"))
    return diff.orphans({"doc_document": docs, "doc_page": pages, "prod_haul": haul})
