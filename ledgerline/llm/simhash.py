"""Near-duplicates by SimHash and a hierarchical index in Gray order.

A text's fingerprint has 64 bits: a bit is 1 if set in over half the hashes of its word shingles. Rows with one
fingerprint collapse to one node, named by its smallest doc_id. Nodes within ``max_bits`` differing bits are linked,
and connected components are the groups.

Search for links, by upper nodes that only fingerprints with a shared masked pattern have in common:

* For few bits k, the 64 bits are cut into m > k blocks; two fingerprints within k bits agree in at least m - k of them.
  Each choice of m - k blocks is a mask, and the fingerprints that agree under it are a node. m grows with the
  table, so that a node keeps to a few fingerprints: 16 bits a node for m = 4 and k = 3, 32 bits for m = 6.
* For more bits the blocks are four, and two fingerprints differ by at most k // 4 bits in one of them: the leading bits
  of each block in turn are the nodes, and pairs of nodes are joined whose patterns differ by k // 4 bits or fewer.

A node, or a pair of nodes, is a unit of work. Large nodes are cut into chunks of a fixed size, and units are pairs of
chunks.

* In a unit, fingerprints are sorted by Gray rank; a prefix pattern that several share becomes one node of the next
  level. Pairs of nodes descend together, adding up the differences of their patterns; a pair whose sum exceeds what is
  allowed goes with all its members, as does a pair whose members are linked already.

A unit returns one link per node that it found connected, to the smallest of its component, so what is
written grows with the nodes and not with the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, only, read

SEED = 42
_U = np.uint64
#: Constants that derive further hashes from a shingle's hash, for fingerprints that confirm a link.
_DERIVE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
#: Prefix lengths of the index's levels.
LEVELS = [0, 4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64]
#: Node pairs that are expanded at once in a unit.
EXPAND = 1_000_000
#: About how many fingerprints an upper node may hold before blocks are made smaller, and how many a chunk holds.
NODE_ROWS, CHUNK_ROWS = 64, 4096


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[a : a + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return total


def _derived(hashes: np.ndarray, by: int) -> np.ndarray:
    x = hashes * _U(by)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def fingerprints(text: str | None, words: int, extra: int = 0) -> list[int]:
    """The fingerprint by XXH64 of all shingles of ``words`` words, and ``extra`` more by hashes derived from it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII white space and A-Z only
    if not w:
        return [0] * (1 + extra)
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    n = len(w) - words + 1
    counts = np.zeros((1 + extra, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 65_280):
        part = w[a : min(a + 65_280, n) + words - 1]
        h = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))], "<u8")
        counts[0] += _bit_counts(h)
        for e in range(extra):
            counts[e + 1] += _bit_counts(_derived(h, _DERIVE[e]))
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


# --- the index of a unit --------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of x in the sequence of Gray codes."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(s))
    return x


class _Labels:
    """Components of rows, by hooking roots to smaller roots and halving paths, for many links at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self.of[p], self.of[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            if not len(p):
                return
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def _expand(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs with na and nb children: the pair, and the child's number on either side, of all combinations."""
    n = na * nb
    pair = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, at // nb[pair], at % nb[pair]


def _rows_of(first: np.ndarray, a: np.ndarray, b: np.ndarray, acc: np.ndarray, labels: _Labels) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows of pairs of leaves, some ``EXPAND`` at once. Leaf i has the rows from first[i] to first[i + 1]."""
    na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
    large = na * nb > EXPAND
    some = np.flatnonzero(~large)
    turns = np.cumsum((na * nb)[some]) // EXPAND
    for part in np.split(some, np.flatnonzero(turns[1:] != turns[:-1]) + 1):
        pair, x, y = _expand(na[part], nb[part])
        pair = part[pair]
        x, y = first[a[pair]] + x, first[b[pair]] + y
        once = (a[pair] != b[pair]) | (x < y)
        yield x[once], y[once], acc[pair][once]
    step = math.isqrt(EXPAND)
    for i in np.flatnonzero(large):
        for s in range(first[a[i]], first[a[i] + 1], step):
            x = np.arange(s, min(s + step, first[a[i] + 1]))
            for t in range(s if a[i] == b[i] else first[b[i]], first[b[i] + 1], step):
                y = np.arange(t, min(t + step, first[b[i] + 1]))
                if (labels.of[x] == labels.of[x[0]]).all() and (labels.of[y] == labels.of[x[0]]).all():
                    continue
                yield np.repeat(x, len(y)), np.tile(y, len(x)), np.full(len(x) * len(y), acc[i])


def unit_links(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, more: np.ndarray, max_bits: int, lead_bits: int, total_bits: int, levels: dict[int, int] | None = None) -> np.ndarray:
    """Component label (a row number) of each row, for rows that belong to one or several units.

    unit, side: a unit joins its rows of side 0 with those of side 1, or if it has only one side, among themselves.
    bits: the rotated fingerprints, with ``more`` distinct in (unit, side). Two rows are linked if these differ by at most
    ``max_bits`` bits, by at most ``lead_bits`` in the first 16, and together with ``more`` by at most ``total_bits``.
    ``levels`` gives other prefix lengths than LEVELS, from 0 to 64, each with the bits that may differ in it.
    """
    levels = levels or {b: lead_bits if b <= 16 else max_bits for b in LEVELS}
    lengths = list(levels)
    order = np.lexsort((*more.T, gray_rank(bits), side, unit))
    unit, side, bits, more = unit[order], side[order], bits[order], more[order]
    labels = _Labels(len(bits))
    starts, patterns = [], []  # by level: each node's first row, and its prefix
    new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
    for b in lengths:
        prefix = bits >> _U(64 - b) if b else np.zeros(len(bits), _U)
        new = new | np.concatenate([[True], prefix[1:] != prefix[:-1]])
        starts.append(np.flatnonzero(new))
        patterns.append(prefix[starts[-1]])
    # a node's children: from kids[level][node] to kids[level][node + 1]
    kids = [np.searchsorted(starts[i + 1], np.append(starts[i], len(bits))) for i in range(len(lengths) - 1)]

    root_unit, root_side = unit[starts[0]], side[starts[0]]
    paired = np.flatnonzero(root_unit[1:] == root_unit[:-1])
    single = np.setdiff1d(np.arange(len(root_unit)), np.concatenate([paired, paired + 1]))
    single = single[root_side[single] == 0]
    stack = [(0, np.concatenate([single, paired]), np.concatenate([single, paired + 1]), np.zeros(len(single) + len(paired), np.int64))]
    while stack:
        level, a, b, acc = stack.pop()
        if level == len(lengths) - 1:
            if not more.shape[1]:
                labels.link(starts[level][a], starts[level][b])
                continue
            for p, q, so_far in _rows_of(np.append(starts[level], len(bits)), a, b, acc, labels):
                ok = so_far + np.bitwise_count(more[p] ^ more[q]).sum(1, dtype=np.int64) <= total_bits
                labels.link(p[ok], q[ok])
            continue
        na, nb = kids[level][a + 1] - kids[level][a], kids[level][b + 1] - kids[level][b]
        size = int((na * nb).sum())
        if size > EXPAND:
            first = np.append(starts[level], len(bits))[:-1]
            low, high = np.minimum.reduceat(labels.of, first), np.maximum.reduceat(labels.of, first)
            todo = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])) if len(first) else np.ones(len(a), bool)
            a, b, acc, na, nb = a[todo], b[todo], acc[todo], na[todo], nb[todo]
            size = int((na * nb).sum())
            if size > EXPAND and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:], acc[half:]), (level, a[:half], b[:half], acc[:half])]
                continue
        pair, x, y = _expand(na, nb)
        x, y = kids[level][a[pair]] + x, kids[level][b[pair]] + y
        own = a[pair] == b[pair]
        if level + 1 == len(lengths) - 1 and not more.shape[1]:
            once = ~own | (x < y)
        else:
            once = ~own | (x <= y)
        pair, x, y = pair[once], x[once], y[once]
        width = lengths[level + 1] - lengths[level]
        low_bits = _U((1 << width) - 1)
        new_acc = acc[pair] + np.bitwise_count((patterns[level + 1][x] ^ patterns[level + 1][y]) & low_bits)
        keep = new_acc <= levels[lengths[level + 1]]
        if keep.any():
            stack.append((level + 1, x[keep], y[keep], new_acc[keep]))
    out = np.empty(len(bits), np.int64)
    out[order] = order[labels.of]
    return out


_UNIT = ["turn", "a", "ax", "b", "bx"]


def _link_units(extra: list[str], max_bits: int, lead_bits: int, total_bits: int, levels: dict[int, int] | None = None):
    """Rows come unit by unit; the last unit of a batch waits for the next batch."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        cols = [rows.column(c).to_numpy().astype(np.int64) for c in _UNIT]
        change = np.zeros(len(rows), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        rep = rows.column("rep").to_numpy()
        more = np.stack([rows.column(c).to_numpy().view(_U) for c in extra], 1) if extra else np.empty((len(rows), 0), _U)
        label = unit_links(np.cumsum(change), rows.column("side").to_numpy(), rows.column("bits").to_numpy().view(_U), more, max_bits, lead_bits, total_bits, levels)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        least = least[label]
        out = np.unique(np.stack([rep, least], 1)[rep != least], axis=0)
        return pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1] for c in _UNIT]
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(_UNIT, last, strict=True):
                same &= batch.column(c).to_numpy() == v.as_py()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut or waiting and any(waiting[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in _UNIT):
                yield links(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    return run


# --- Spark ----------------------------------------------------------------------------------------------------------


def _fingerprint_rows(words: int, extra: int):
    names = ["fp", *(f"c{i}" for i in range(extra))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprints(t, words, extra) for t in batch.column("text").to_pylist()], "<u8").reshape(-1, 1 + extra)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(out[:, i].copy().view(np.int64)) for i in range(1 + extra))], names=["doc_id", *names])

    return run


def near_links(nodes: DataFrame, max_bits: int, extra: list[str], total_bits: int = 0) -> DataFrame:
    """u, v: links that connect what is connected by fingerprints within ``max_bits``. ``nodes`` has rep, fp
    and the columns ``extra`` (distinct together), whose bits count with those of fp towards ``total_bits``."""
    n = max(1, nodes.count())
    lead = max_bits // 4
    if not lead:
        blocks = next((m for m in range(max_bits + 1, max_bits + 4) if 64 * (m - max_bits) // m >= math.log2(n / NODE_ROWS)), max_bits + 4)
        turned = _masked(nodes, max_bits, blocks)
        masks = [0]
    else:
        # few upper nodes, as a node is joined with all that differ in lead bits; a block's bits at most
        width = max(6, min(16, math.ceil(math.log2(n / 16_384 + 1))))
        bits = F.when(F.col("turn") == 0, F.col("fp"))
        for i in (1, 2, 3):
            bits = bits.when(F.col("turn") == i, F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)))
        turned = nodes.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("bits", bits.otherwise(F.col("fp")))
        turned = turned.withColumn("own", F.shiftrightunsigned("bits", 64 - width)).drop("fp")
        masks = [sum(1 << i for i in c) for k in range(lead + 1) for c in combinations(range(width), k)]
    # in a masked node all agree where the mask is, wherever that is, so no bits lead
    return joined_nodes(turned, masks, extra, _link_units(extra, max_bits, lead or max_bits, total_bits))


def joined_nodes(turned: DataFrame, masks: list[int], extra: list[str], link) -> DataFrame:
    """u, v: what ``link`` finds in each unit, a pair of chunks of upper nodes whose patterns differ by one of ``masks``.
    ``turned`` has turn, own (the pattern), bits, rep and ``extra`` of each fingerprint in a node."""
    # only nodes of several chunks are listed; a node that isn't has one, or no rows
    sizes = turned.groupBy("turn", "own").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).cast("int").alias("chunks")).where("chunks > 1")
    sizes, _ = materialise(sizes, "simhash-nodes")
    chunk = F.coalesce(F.pmod(F.xxhash64("bits", *extra), F.col("chunks")).cast("int"), F.lit(0))
    chunked = turned.join(sizes, ["turn", "own"], "left").withColumn("chunk", chunk).drop("chunks")
    other = chunked.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("other", F.col("mask").bitwiseXOR(F.col("own")))
    other = other.join(sizes.withColumnRenamed("own", "other"), ["turn", "other"], "left")
    other = other.withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    mine, its = F.struct(F.col("own").alias("n"), F.col("chunk").alias("x")), F.struct(F.col("other").alias("n"), F.col("other_chunk").alias("x"))
    other = other.withColumn("mine", mine).withColumn("its", its)
    low, high = F.least("mine", "its"), F.greatest("mine", "its")
    units = other.select("turn", low["n"].alias("a"), low["x"].alias("ax"), high["n"].alias("b"), high["x"].alias("bx"), (F.col("mine") > F.col("its")).cast("int").alias("side"), "bits", "rep", *extra)
    placed = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return placed.mapInArrow(link, "u long, v long")


def _masked(nodes: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """turn, own, bits: the nodes that each fingerprint is in, one for each choice of all but ``max_bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of_block = [((1 << (b - a)) - 1) << (64 - b) for a, b in itertools.pairwise(edges)]
    masks = [sum(of_block[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("turn"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("own")) for i, m in enumerate(signed)])
    rest = [c for c in nodes.columns if c != "fp"]
    return nodes.select(F.col("fp").alias("bits"), *rest, F.explode(keys).alias("node")).select("node.turn", "node.own", "bits", *rest)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, extra: int = 0, total_bits: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id that
    can be reached over links.

    Words are split at ASCII white space after lower-casing A-Z; texts of fewer than ``words`` words are one
    shingle. A text without words, null or empty, has the fingerprint zero, which is linked like any other. With
    ``extra`` further fingerprints, two documents are linked only if these and the first together differ by at
    most ``total_bits``. Rows that repeat a doc_id with other texts link the groups of those texts. Rows of a null
    doc_id are in the group of their fingerprint (null if no other row has it) but link nothing. An empty table gives
    an empty result. Other columns play no part.
    """
    checks = [f"c{i}" for i in range(extra)]
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in checks)
    prints, _ = materialise(rows.mapInArrow(_fingerprint_rows(words, extra), schema), "simhash-prints")
    key = ["fp", *checks]
    nodes, _ = materialise(prints.where("doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep")), "simhash-reps")
    links = near_links(nodes, max_bits, checks, total_bits)
    # a doc_id of several texts is one document: it links their nodes
    again = prints.where("doc_id IS NOT NULL").select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = prints.join(again.select("doc_id"), "doc_id").join(nodes, key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(links.unionByName(again))
    of_node = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(*key, F.coalesce("root", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of_node, key, "left").select("doc_id", hexed, "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), words=3, max_bits=3)
