"""Lines that several documents share, kept only in the first document that holds them.

1. Each document yields the distinct 128-bit hashes of its lines that can count (``min_chars`` code points or more).
2. Hashes are aggregated to (first document, last document, number of holders); a line is shared when first and last
   differ. Partial aggregation comes before the shuffle, so a line in a third of all documents is one row per task.
3. The distinct hashes are dealt over shards. For each shard a minimal perfect hash maps its hashes to 0..n-1, and
   indexes three arrays: 32-bit fingerprints, holder counts (saturating at 65,535) and first documents.
4. Documents' hashes go to the shard that owns them and probe its arrays. A shard whose probes are many is copied
   and its probes are dealt over the copies by document, so no task gets more than about its share. The index row of
   a shard comes first in its partition's order, and probes stream past it.
5. The hashes that a document loses are collected per document and its text is written without those lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_rows, give_back, materialise, read

MIN_CHARS = 10
#: Lines that a shard of the index should hold; the number of shards follows that of lines.
SHARD_LINES = 4096
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_U = np.uint64


def line_key(line: str) -> str:
    return line.strip(_STRIP).translate(_LOWER)


def _digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for lines that are too short to count."""
    return [_digest(k) if len(k := line_key(x)) >= min_chars else None for x in (text or "").split("\n")]


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    x = hi ^ (lo * _U(0x9E3779B97F4A7C15) + _U(level * 0xD1B54A32D192ED03 % 2**64))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class PerfectHash:
    """Levels of bit arrays. A key that is alone at its place in a level sets the bit there; the others go on to the
    next level. A key's number is the rank of its bit among all set bits, so numbers run from 0 to n-1."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits = sizes, bits
        self.ranks = []
        below = 0
        for b in bits:
            ones = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(below + np.concatenate([[0], np.cumsum(ones)]))
            below = int(self.ranks[-1][-1])
        self.n = below

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """The keys must be distinct."""
        sizes, bits = [], []
        while len(hi):
            m = max(64, -(-len(hi) * 5 // 4 // 64) * 64)
            at = (_mix(hi, lo, len(sizes)) % _U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            hi, lo = hi[rest], lo[rest]
        return cls(sizes, bits)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 for some that aren't in the set, any number for the others that aren't."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = _mix(hi[left], lo[left], level) % _U(m)
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            w = self.bits[level][word]
            hit = (w >> bit) & _U(1) == 1
            below = w[hit] & ((_U(1) << bit[hit]) - _U(1))
            out[left[hit]] = self.ranks[level][word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<u8").tobytes() + b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        all_words = np.frombuffer(data, "<u8")
        k = int(all_words[0])
        sizes = [int(x) for x in all_words[1 : 1 + k]]
        ends = 1 + k + np.cumsum([0, *(m // 64 for m in sizes)])
        return cls(sizes, [all_words[a:b] for a, b in zip(ends, ends[1:], strict=False)])


def _fingerprint(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (_mix(hi, lo, 1 << 20) >> _U(32)).astype(np.uint32)


class LineIndex:
    """A shard: fingerprint, holder count and first document by the line's number."""

    def __init__(self, keys: PerfectHash, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.keys, self.prints, self.counts, self.firsts = keys, prints, counts, firsts

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> LineIndex:
        keys = PerfectHash.build(hi, lo)
        at = keys.find(hi, lo)
        p, c, f = np.zeros(keys.n, np.uint32), np.zeros(keys.n, np.uint16), np.zeros(keys.n, np.int64)
        p[at], c[at], f[at] = _fingerprint(hi, lo), np.minimum(counts, 65_535), firsts
        return cls(keys, p, c, f)

    def loses(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document must give up a line: several hold it, and another comes first."""
        at = self.keys.find(hi, lo)
        known = at >= 0
        at = np.where(known, at, 0)
        if not self.keys.n:
            return known
        return known & (self.prints[at] == _fingerprint(hi, lo)) & (self.counts[at] >= 2) & (self.firsts[at] != doc)

    def to_bytes(self) -> bytes:
        keys = self.keys.to_bytes()
        head = np.array([len(keys), self.keys.n], "<u8").tobytes()
        return head + keys + self.firsts.astype("<i8").tobytes() + self.prints.astype("<u4").tobytes() + self.counts.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        k, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
        at = 16 + k
        keys = PerfectHash.from_bytes(data[16:at])
        return cls(keys, np.frombuffer(data, "<u4", n, at + 8 * n), np.frombuffer(data, "<u2", n, at + 12 * n), np.frombuffer(data, "<i8", n, at))


# --- Spark ----------------------------------------------------------------------------------------------------------


def _extract(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_rows(batches):
            ids, docs = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc is not None and text:
                    own = set(line_hashes(text, min_chars))
                    own.discard(None)
                    ids.extend(own)
                    docs.extend([doc] * len(own))
            hashes = np.frombuffer(b"".join(ids), ">i8").reshape(-1, 2).astype("<i8")
            yield pa.record_batch([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(docs, pa.int64())], names=["hi", "lo", "doc_id"])
        give_back()

    return run


def _shard(hi: str, shards: int):
    return F.pmod(F.xxhash64(hi), F.lit(shards).cast("long"))


def _build(key: tuple, lines: pa.Table) -> pa.Table:
    u = [lines.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")]
    index = LineIndex.build(*u, lines.column("holders").to_numpy(), lines.column("first").to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "probes": pa.array([int(lines.column("holders").to_numpy().sum())], pa.int64()), "index": pa.array([index.to_bytes()], pa.binary())})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (shard, piece, kind): an index, then the probes of its piece."""
    index: LineIndex | None = None
    at = None
    for batch in batches:
        shard, piece = batch.column("shard").to_numpy(), batch.column("piece").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])])) if len(shard) else []
        kind, hi, lo, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "hi", "lo", "doc_id"))
        packed = batch.column("index")
        for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
            if (shard[a], piece[a]) != at:
                at, index = (shard[a], piece[a]), None
            if kind[a] == 0:
                index, a = LineIndex.from_bytes(packed[int(a)].as_py()), a + 1
            if b > a:
                if index is None:
                    raise ValueError(f"probes came before the index of shard {at[0]}")
                h, x, d = hi[a:b].view(np.uint64), lo[a:b].view(np.uint64), doc[a:b]
                lost = index.loses(h, x, d)
                if lost.any():
                    yield pa.record_batch([pa.array(d[lost]), pa.array(hi[a:b][lost]), pa.array(lo[a:b][lost])], names=["doc_id", "hi", "lo"])


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES) -> DataFrame:
    """doc_id, hi, lo: the line hashes that each document must give up. ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    held, _ = materialise(docs.mapInArrow(_extract(min_chars), "hi long, lo long, doc_id long"), "line-hashes")
    lines = held.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    # rows that repeat a doc_id are one holder: first and last tell whether there are several
    holders = F.when(F.col("first") == F.col("last"), 1).otherwise(F.greatest("rows", F.lit(2)))
    lines, _ = materialise(lines.select("hi", "lo", "first", "rows", holders.alias("holders")), "line-counts")
    total = lines.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).first()
    shards = max(1, -(-total.n // shard_lines))
    index = lines.withColumn("shard", _shard("hi", shards)).groupBy("shard").applyInArrow(_build, "shard long, probes long, index binary")
    index, _ = materialise(index, "line-index")
    # a piece is at most a quarter of a partition's even share of the probes, or 1024 rows
    share = max(1024, (total.rows or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index = index.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("probes") / F.lit(share))).cast("int"))
    none = F.lit(None)
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("doc_id"), "index")
    # a shard of several pieces has over a share of the probes: at most four for each partition, of two integers
    pieces = F.broadcast(index.where("pieces > 1").select("shard", "pieces"))
    probes = held.withColumn("shard", _shard("hi", shards)).join(pieces, "shard", "left")
    probes = probes.select("shard", F.coalesce(F.pmod(F.xxhash64("doc_id", "hi"), F.col("pieces")).cast("int"), F.lit(0)).alias("piece"), F.lit(1).alias("kind"), "hi", "lo", "doc_id", none.cast("binary").alias("index"))
    placed = copies.unionByName(probes).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "kind")
    return placed.mapInArrow(_probe, "doc_id long, hi long, lo long")


def rewrite(text: str | None, lost: set[bytes], min_chars: int) -> tuple[str, int, int]:
    """The text without the lines whose key is in ``lost``; its number of lines, and of those that went."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    kept = [x for x in lines if len(k := line_key(x)) < min_chars or _digest(k) not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _rewrite(min_chars: int, names: list[str]):
    """``names``: the columns that pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_rows(batches):
            texts, n, dropped = [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                t, a, b = rewrite(text, set(lost or ()), min_chars)
                texts.append(t if text is not None else None)
                n.append(a)
                dropped.append(b)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "text", "n_lines", "n_dropped"])
        give_back()

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text without the shared lines, n_lines before, n_dropped; with
    ``carry`` also ``others``, a struct of the row's other columns.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at least
    ``min_chars`` code points that is in two documents or more stays only in the smallest doc_id that holds it, in
    all the lines there. A null text stays null and counts as one empty line, as an empty one does; a document that
    loses every line has the empty text. Rows that repeat a doc_id are one document. Rows of a null doc_id are left as
    they are and don't count as holders. An empty table gives an empty result. Other columns play no part.
    """
    others = [docs[f"`{c}`"] for c in docs.columns if c not in (id_col, text_col)] if carry else []
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"), *([F.struct(*others).alias("others")] if others else []))
    lost = lost_lines(rows.select("doc_id", "text"), min_chars, shard_lines)
    both = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    lost = lost.groupBy("doc_id").agg(F.collect_list(F.concat(both("hi"), both("lo"))).alias("lost"))
    through = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType([*through, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.join(lost, "doc_id", "left").mapInArrow(_rewrite(min_chars, [f.name for f in through]), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS f, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, i, line, coalesce(n >= 2 AND f <> doc_id, false) AS lost FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
