"""Exact duplicates by a content sort.

Rows are range-partitioned by splitters that Spark samples from (head of the normalised text, its hash, salt), sorted
externally by the whole normalised text, and each row is compared in full with its neighbour; a run of equal
neighbours is a group. Only built-in functions are used.

The splitters' keys are short whatever the texts' length: a head of the text and its 64-bit hash. Both are functions of
the normalised text, so equal texts always meet; the comparison that decides is of whole texts.

A text that holds more than 1/256 of all rows (at most 256 such) is dealt over ``salt_pieces`` places. Each place then
has its own run, and the first rows of those runs, at most ``salt_pieces`` for each such text, are sorted and
compared a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BLANKS, materialise, only, read, text_or_empty

HEAD_CHARS = 24
HOT_SHARE = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_pieces: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the one with the most code points
    stays, then the smallest id. A null text counts as empty, so null, empty and blank texts form one group. A null id
    comes after all others. Of rows that repeat with the same id and text, exactly one is kept. An empty table gives
    an empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    norm = F.regexp_replace(text_or_empty(), f"[{BLANKS}]+", "")
    keyed = rows.select("doc_id", norm.alias("norm"), F.char_length(text_or_empty()).alias("chars"))
    keyed = keyed.withColumn("h", F.xxhash64("norm")).withColumn("head", F.substring("norm", 1, HEAD_CHARS))
    least = max(rows.count() // HOT_SHARE, 32)
    # fewer than HOT_SHARE keys can hold more than 1/HOT_SHARE of the rows each
    hot = [r.h for r in keyed.groupBy("h").count().where(F.col("count") > least).select("h").collect()]
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salt_pieces))).otherwise(F.lit(0))
    placed = keyed.withColumn("salt", salt.cast("int")).repartitionByRange("head", "h", "salt")

    best = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    place = ["head", "h", "salt"]
    sorted_by_text = Window.partitionBy(*place).orderBy("norm", *best)
    first = F.when(F.lag("norm").over(sorted_by_text).eqNullSafe(F.col("norm")), 0).otherwise(1)
    runs = (
        placed.withColumn("first", first)
        .withColumn("run", F.sum("first").over(sorted_by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", *place, "run", "chars", "first", F.sha2("norm", 256).alias("text_sha256"), F.when(is_hot & (F.col("first") == 1), F.col("norm")).alias("leader"))
    )
    in_run = Window.partitionBy(*place, "run")
    local = (
        runs.withColumn("keep_id", F.first("doc_id").over(in_run.orderBy(F.col("first").desc(), *best)))
        .withColumn("group_size", F.count(F.lit(1)).over(in_run))
        .withColumn("kept", F.col("first") == 1)
    )
    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not hot:
        return local.select(*result)

    local, _ = materialise(local, "exact-dedup-runs")
    by_text = Window.partitionBy("head", "h").orderBy("leader", *best)
    leaders = (
        local.where(F.col("leader").isNotNull())
        .withColumn("starts", F.when(F.lag("leader").over(by_text).eqNullSafe(F.col("leader")), 0).otherwise(1))
        .withColumn("text_no", F.sum("starts").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("leader")
    )
    of_text = Window.partitionBy("head", "h", "text_no")
    leaders = leaders.select(
        *place,
        "run",
        F.first("doc_id").over(of_text.orderBy(F.col("starts").desc(), *best)).alias("all_keep"),
        F.sum("group_size").over(of_text).alias("all_size"),
        (F.col("starts") == 1).alias("all_first"),
    )
    joined = local.join(leaders, [*place, "run"], "left")
    found = F.col("all_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(found, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("all_first", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
