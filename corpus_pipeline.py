"""From raw documents to packed training sequences, in stages that each write a table which the next reads."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import language, line_dedup, near, packing
from ledgerline.llm.shared import materialise, new_path, passing, read, small_batches

#: Near-duplicates: shingles of five words, and a Jaccard similarity of 0.8, as a quotient.
WORDS, SIMILARITY = 5, (4, 5)


#: The part of a text's distinct n-grams that labelled texts must have; one of a language that none of them is in has less.
LEAST_FAMILIAR = 0.1


def _whole(docs: DataFrame) -> Column:
    """A row in one column, so that no name of it is beside another."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it in ``lang``. What goes: null texts, texts without a letter, and those
    less than LEAST_FAMILIAR of whose n-grams any labelled text has, as of another script. The model learns from
    ``docs``; where it can learn no language, what has a letter stays as it is.

    Repeated rows and ids get the same answer each, long texts are looked at whole, an empty table gives an empty one, and
    all other columns stay, whatever their names."""
    small_batches(spark)
    model = language.train_on_documents(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(_whole(docs), "text")
    found = language.identify(rows, model, keep=["doc"], familiar=True)
    found = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("familiar") >= LEAST_FAMILIAR))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; n_chars follows the text. No row goes: a document that loses
    all its lines has the empty text, null texts and rows without doc_id stay as they are, and rows that repeat a doc_id
    are one holder of their lines. An empty table gives an empty one; other columns stay, whatever their names."""
    small_batches(spark)
    out = line_dedup.line_dedup(docs, carry=True)
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[now.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. A row without doc_id names no
    document and goes; of rows that repeat a doc_id one stays. All texts without words are one group. An empty table gives
    an empty one; other columns stay, whatever their names."""
    small_batches(spark)
    groups = near.jaccard_groups(docs, WORDS, SIMILARITY)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.select("doc_id", "text", _whole(docs)).join(first, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return kept.withColumn("place", F.row_number().over(one)).where("place = 1").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, placed in sequences: a row for each piece of a document, with its ids. Rows that repeat
    a doc_id or have none are documents of their own, null and empty texts have the end's id alone, and an empty table
    gives no pieces."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_identified),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Kernels, fingerprints and tokenizers have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with passing(spark):
            docs, _ = materialise(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
