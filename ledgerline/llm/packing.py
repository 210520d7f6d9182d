"""Packing of tokenized documents into sequences by sums of squares.

Documents are encoded where they are read; longer ones are cut into pieces of the capacity, which are sequences by
themselves. The others are packed by their lengths alone. In decreasing order of length, a piece goes to that open
sequence it fits into for which the sum over all residual gaps of the squared number of open sequences with that gap
becomes smallest; of equal sums the smallest gap, and a new sequence only if it fits nowhere. That rule keeps many
different gaps open, so that later, smaller pieces find one that they fill.

Packing runs where the pieces' table is read, in slices of up to ``slice_rows`` pieces, fewer where ids go along, so neither memory nor
time depends on how pieces are distributed; each slice leaves about one sequence partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, materialise, only, read
from .tokens import encoder
from .words import with_end

CAPACITY = 2048
#: Pieces that are packed together, and ids that go along with them.
SLICE_ROWS, SLICE_IDS = 131_072, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NONE = np.iinfo(np.int64).max


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths are from 1 to ``capacity``."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # change of the sum by filling gap g = s, s + 1, ...: n[g] falls by one, and n[g - s] rises by one unless g = s
        change = np.where(n[s:capacity] > 0, 1 - 2 * n[s:capacity], _NONE)
        if len(change) > 1:
            change[1:] += np.where(change[1:] < _NONE, 2 * n[1 : capacity - s] + 1, 0)
        k = int(change.argmin()) if len(change) else 0
        if len(change) and change[k] < _NONE:
            gap = s + k
            n[gap] -= 1
            sequence[i] = at[gap].pop()
        else:
            gap = capacity
            sequence[i], sequences = sequences, sequences + 1
        offset[i] = capacity - gap
        if gap > s:
            n[gap - s] += 1
            at[gap - s].append(int(sequence[i]))
    return sequence, offset


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("doc_id")
            done = 0
            for found in encoder(path).encode_arrow(batch.column("text")):
                ids, at = with_end(found, end_id)
                sizes = np.diff(at)
                n = -(-sizes // capacity)
                of = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((at[of] + start).tolist(), (at[of] + start + length).tolist(), strict=True)]
                cols = [rows.take(pa.array(done + of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    narrow = memoryview(ids.astype(_kind(path)).tobytes())
                    width = narrow.nbytes // max(1, len(ids))
                    cols.append(pa.array([narrow[width * a : width * b] for a, b in zip((at[of] + start).tolist(), (at[of] + start + length).tolist(), strict=True)], pa.binary()))
                    names.append("packed")
                yield pa.record_batch(cols, names=names)
                done += len(sizes)

    return run


def _kind(path: str) -> str:
    """How ids of a tokenizer are kept on their way: in as few bytes as all of them fit."""
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _unpacked(packed: pa.ChunkedArray, kind: str) -> pa.ListArray:
    data = [x.as_buffer() for x in packed]
    ends = np.concatenate([[0], np.cumsum([x.size for x in data])]).astype(np.int32) // np.dtype(kind).itemsize
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), kind).astype(np.int32)))


def _place(path: str, capacity: int, slice_rows: int, slice_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []
        held = ids = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal first, waiting, held, ids
            rows = pa.Table.from_batches(waiting).combine_chunks()
            sequence, offset = sum_of_squares(rows.column("length").to_numpy(), capacity)
            if "packed" in rows.column_names:
                rows = rows.set_column(rows.column_names.index("packed"), "ids", _unpacked(rows.column("packed"), _kind(path)))
            rows = rows.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))
            first, waiting, held, ids = first + int(sequence.max()) + 1, [], 0, 0
            yield from rows.to_batches()
            give_back()

        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, slice_rows - held)
                waiting.append(part)
                a, held = a + part.num_rows, held + part.num_rows
                if "packed" in part.schema.names:
                    ids += pc.sum(part.column("length")).as_py()
                if held == slice_rows or ids >= slice_ids:
                    yield from close()
        if held:
            yield from close()
        give_back()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, start (its document's ids before it), length, ids_crc32, sequence_id,
    offset; ``with_ids`` adds the ids.

    A document is its text's ids and ``end_id``; a null or empty text has the end id only. Only documents of more than
    ``capacity`` ids are cut. Rows that repeat a doc_id, or have none, are documents of their own. An empty table gives
    an empty result. Other columns play no part.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    kept, given = (", packed binary", ", ids array<int>") if with_ids else ("", "")
    pieces, _ = materialise(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), PIECES + kept), "pieces")
    return pieces.mapInArrow(_place(tokenizer, capacity, slice_rows, SLICE_IDS), PIECES + given + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
