"""Token ids in files of 64-bit words (Simple-8b).

A word's top four bits select how many ids its other 60 bits hold, and in how many bits each: from 120 zeros to one id
of 60 bits. An id that needs more is an escape: its word holds a place in the block's list of escapes.

A token table is Parquet, so that any store will do and lost tasks are repeated: a row is a block with its shard, its
number in the shard, the ids before it in the shard, how many ids it has, and a payload. A payload holds whole
documents: their ids, the offset of each document in the block, the words and the escapes, so a block is decoded by
itself and by array operations. Shards follow the order of documents, as do the blocks of a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, only, read
from .tokens import encoder
from .words import with_end

#: By selector: ids in a word, bits of each. Selector 0 is an escape.
LAYOUTS = [(1, 60), (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1), (120, 0)]
ESCAPE = 0
MAGIC = b"S8B1"
#: A block is closed when it has so many ids.
BLOCK_IDS = 65_536
BLOCK_SCHEMA = "shard int, block int, ids_before long, n_ids long, payload binary"
_U = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    w = np.zeros(len(values), np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        big = values >= (_U(1) << _U(half))
        w[big] += half
        values = np.where(big, values >> _U(half), values)
    return w + (values > 0).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes. Each word takes as many of the next values as fit any layout."""
    values = np.ascontiguousarray(values, dtype=_U)
    n = len(values)
    if not n:
        return np.zeros(0, _U), np.zeros(0, _U)
    if int(values.max()) < 1 << 24:  # a single-precision number's exponent is the width
        widths = np.maximum((values.astype(np.float32).view(np.int32) >> 23) - 126, 0).astype(np.uint8)
    else:
        widths = _widths(values)
    padded = np.concatenate([widths, np.zeros(120, np.uint8)])
    selector = np.where(widths > 60, ESCAPE, 1).astype(np.uint8)
    span, of_span = padded, 1  # the widest of the next of_span values
    for k, (count, bits) in enumerate(LAYOUTS[2:], 2):
        while of_span * 2 <= count:
            span = np.maximum(span[:-of_span], span[of_span:])
            of_span *= 2
        both = np.maximum(span[:n], span[count - of_span : count - of_span + n])
        np.copyto(selector, k, where=both <= bits)
    counts = np.array([c for c, _ in LAYOUTS])
    step, starts, i = counts[selector].tolist(), [], 0
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(_U) << _U(60)
    values = np.concatenate([values, np.zeros(120, _U)])
    for k in np.unique(chosen):
        at = np.flatnonzero(chosen == k)
        count, bits = LAYOUTS[k]
        if k == ESCAPE:
            words[at] |= np.arange(len(at), dtype=_U)
        elif bits:
            for j in range(count):
                words[at] |= values[starts[at] + j] << _U(j * bits)
    return words, values[starts[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n values."""
    selector = (words >> _U(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUTS])[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U)
    body = words & _U((1 << 60) - 1)
    for k in np.unique(selector):
        at = np.flatnonzero(selector == k)
        count, bits = LAYOUTS[k]
        first = ends[at] - count
        if k == ESCAPE:
            out[first] = escapes[body[at].astype(np.int64)]
        elif bits:
            for j in range(count):
                out[first + j] = (body[at] >> _U(j * bits)) & _U((1 << bits) - 1)
    return out[:n]


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    words, escapes = pack(np.concatenate(ids) if ids else np.zeros(0, _U))
    offsets = np.cumsum([0, *map(len, ids)]).astype("<u8")
    head = np.array([len(doc_ids), len(words), len(escapes)], "<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    named = np.array([x or 0 for x in doc_ids], "<i8")
    return MAGIC + head.tobytes() + offsets.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes() + named.tobytes() + known.tobytes()


def decode_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their offsets (one more than documents), and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n_words, n_escapes = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
    at = 28
    offsets = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at := at + 8 * (docs + 1))
    escapes = np.frombuffer(data, "<u8", n_escapes, at := at + 8 * n_words)
    named = np.frombuffer(data, "<i8", docs, at := at + 8 * n_escapes)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    return [int(x) if k else None for x, k in zip(named, known, strict=True)], offsets, unpack(words, escapes, int(offsets[-1]))


# --- Spark ----------------------------------------------------------------------------------------------------------


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts_to_ids = TaskContext.get().partitionId(), encoder(path).encode_arrow
        docs, ids = [], []
        block = before = held = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, ids, block, before, held
            payload = encode_block(docs, ids)
            out = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "block", "ids_before", "n_ids", "payload"])
            docs, ids, block, before, held = [], [], block + 1, before + held, 0
            return out

        for batch in batches:
            rows = iter(batch.column("doc_id").to_pylist())
            for part in texts_to_ids(batch.column("text")):
                found, at = with_end(part, end_id)
                for a, b, doc in zip(at[:-1].tolist(), at[1:].tolist(), rows, strict=False):
                    docs.append(doc)
                    ids.append(found[a:b])
                    held += b - a
                    if held >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order, each followed by ``end_id``.

    A null text counts as empty: its document has the end id only. Null doc_ids come last. Rows that repeat a doc_id
    stand next to each other, ordered by text. An empty table gives a table without blocks. Other columns play no part.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    placed.mapInArrow(_encode(tokenizer, end_id), BLOCK_SCHEMA).write.parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the ids before them in all shards."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row for each task that wrote
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", base.alias("base"))
    return blocks.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("ids_before")).alias("start"), "payload")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            docs, offsets, ids = decode_block(payload.as_py())
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + offsets[:-1]), lists], names=["doc_id", "start", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            docs, offsets, ids = decode_block(payload.as_py())
            if len(ids) and int(ids.max()) >= 1 << 32:
                raise ValueError("an id needs more than 32 bits")
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids."""
    return _blocks(spark, path).mapInArrow(_documents, "doc_id long, start long, ids array<long>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the decoded ids, which don't leave the task."""
    return _blocks(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file_digests(spark, path)
