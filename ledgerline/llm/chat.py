"""Chat formatting of logged conversations whose cumulative snapshots are collapsed.

A log may hold a conversation several times, each time with more turns. Every prefix of a conversation has a rolling
hash: that of the prefix before, with the turn's role and text. A conversation whose whole hash is the hash of a proper
prefix of another is a snapshot of it and goes, by an anti-join; of equal conversations the smallest conv_id stays.
What is left is rendered.

Turns are dealt by conversation and stream past in order, so hashing holds one hash at a time. Equal hashes, of which
a common first turn makes many, are aggregated in part before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, only, read

#: Around a turn, with its role and text. "<|" in a role or text is written as "< |", and a line end in a role as a space,
#: so neither can end its turn or begin another.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (conv_id, turn, digest) to the rolling hash of each prefix; the last of a conversation is its whole."""
    conv, n, rolling, waiting = None, 0, b"", None
    for batch in batches:
        out: list[tuple] = []
        for c, d in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if waiting is not None:
                out.append((*waiting, c != conv))
            if c != conv:
                conv, n, rolling = c, 0, b""
            n, rolling = n + 1, hashlib.blake2b(rolling + d.encode(), digest_size=16).digest()
            waiting = (conv, n, rolling)
        if out:
            yield _prefixes(out)
    if waiting is not None:
        yield _prefixes([(*waiting, True)])


def _prefixes(rows: list[tuple]) -> pa.RecordBatch:
    c, n, h, whole = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(whole, pa.bool_())], names=["conv_id", "n_turns", "hash", "whole"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations, itself included), rendered: the maximal conversations.

    Turns are in the order of turn, nulls last, and within a turn's number in that of their digest. Rows that repeat in
    all four columns count once. A null role or text counts as empty. Marks of the template in either are broken up. Rows without conv_id belong to no conversation and
    go. An empty table gives an empty result. Other columns play no part. A conversation is rendered as one value, so
    its texts must fit in one.
    """
    rows = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")
    digests = rows.select("conv_id", "turn", digest).distinct()
    ordered = digests.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "digest")
    prefixes, _ = materialise(ordered.mapInArrow(_roll, "conv_id long, n_turns long, hash binary, whole boolean"), "chat-prefixes")
    whole = prefixes.where("whole").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.where("NOT whole").select("hash").distinct()
    kept = whole.join(proper, "hash", "left_anti").select("conv_id", "n_turns", "copies")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    named = F.replace(safe("role"), F.lit("\n"), F.lit(" "))
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", digest, F.concat(F.lit(template[0]), named, F.lit(template[1]), safe("text"), F.lit(template[2])).alias("shown"))
    shown = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return shown.select("conv_id", "n_turns", "copies", F.array_join(F.col("turns.shown"), "").alias("rendered"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(digest ORDER BY turn NULLS LAST, digest) AS turns,
             string_agg('<|im_start|>' || replace(replace(role, '<|', '< |'), chr(10), ' ') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, digest) AS rendered
      FROM d GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(turns, 1, n) AS turns FROM (SELECT turns, unnest(generate_series(1, len(turns) - 1)) AS n FROM c)),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns)
SELECT c.conv_id, c.n_turns, w.copies, c.rendered
FROM w JOIN c USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
"""
