"""Near-duplicates by SimHash and its hierarchical index, confirmed by the Jaccard similarity of whole sets of shingles.

Rows with one set of shingles collapse to one node, named by its smallest doc_id. A set's fingerprint has a bit for each of
POOL + 128 hash functions: 1 if set in over half the shingles' hashes. At the similarity 0.8 two fingerprints differ in 15 % of
their bits, so no bound on a few bits finds such pairs. Masks pick some bits of the pool each; nodes that agree under a mask are
an upper node of the index (simhash.py), in which the other 128 bits, in Gray order, are joined from level to level with their
differences added up. There are as many masks as it takes for a pair at the wanted similarity to agree under none with a
probability of 1 in 100,000; the bounds on differing bits lose about as much. What is linked so are clusters of candidates.

A cluster's nodes come together with their sets, and every pair that agrees under a mask is linked if its similarity, from the
whole sets, reaches the wanted one. Pairs that are linked already, by whatever way, need no comparison. Connected
components of the links are the groups.

Large clusters are cut into chunks, and units are pairs of chunks; small ones share a unit. Shingles are compared by their
64-bit hashes, sets for collapsing by a 64-bit hash and their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_rows, give_back, materialise, only
from .simhash import SEED, _Labels, _link_units, joined_nodes

#: Bits of the fingerprint that masks pick from; 128 more, in two words, are compared.
POOL = 1024
_WORDS = POOL // 64 + 2
_random = np.random.default_rng(SEED)
_MULTIPLIERS = _random.integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Each mask's bits, for patterns of up to 24 bits.
_PICKED = np.argsort(_random.random((800, POOL)), axis=1)[:, :24]
#: About how many fingerprints an upper node may hold before patterns get longer, and their least length.
NODE_ROWS, LEAST_WIDTH = 1024, 10
#: The part of pairs at the wanted similarity that may agree under no mask.
LOST = 1e-5
#: Standard deviations that differing bits may be above what is expected at the wanted similarity.
SLACK = 4.6
_IN_UNIT = ["unit", "a", "b", "side", "cluster", "rep"]
#: Shingles in a chunk of a cluster, and about as many in a unit of small clusters.
CHUNK = 1 << 21


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of all shingles, in order; none for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII white space and A-Z only
    if not w:
        return np.zeros(0, "<u8")
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))], "<u8"))


def set_key(shingles: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes(), SEED), ">i8")[0])


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as bytes: two words that are compared, then the pool. Zero for an empty set."""
    total = np.zeros(64 * _WORDS, np.int64)
    for a in range(0, len(shingles), 255 * 8):
        x = shingles[a : a + 255 * 8, None] * _MULTIPLIERS
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little")
        for c in range(0, len(bits), 255):
            total += bits[c : c + 255].sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(shingles), bitorder="little")


def differing(similarity: tuple[int, int]) -> float:
    """The part of their bits in which fingerprints of two sets of this similarity and of equal size differ."""
    num, den = similarity
    return math.acos(2 * num / (num + den)) / math.pi


def turns_of(width: int, similarity: tuple[int, int]) -> int:
    """How many masks of this many bits it takes."""
    agree = (1 - differing(similarity)) ** width
    return math.ceil(math.log(LOST) / math.log(max(1 - agree, LOST)))


def width_of(nodes: int, similarity: tuple[int, int]) -> int:
    """Bits of a mask: enough for upper nodes of about NODE_ROWS, but no more than there are masks for."""
    width = max(LEAST_WIDTH, min(_PICKED.shape[1], math.ceil(math.log2(max(1, nodes) / NODE_ROWS))))
    return next(w for w in range(width, 0, -1) if turns_of(w, similarity) <= len(_PICKED))


def most_bits(of: int, similarity: tuple[int, int]) -> int:
    """How many of so many bits may differ."""
    p = differing(similarity)
    return min(of, math.ceil(of * p + SLACK * math.sqrt(of * p * (1 - p))))


def patterns(prints: np.ndarray, width: int, turns: int) -> np.ndarray:
    """A row for each fingerprint, a column for each mask: the bits under it."""
    out = np.empty((len(prints), turns), np.int32)
    weights = (1 << np.arange(width)).astype(np.int32)
    for a in range(0, len(prints), 256):
        bits = np.unpackbits(prints[a : a + 256, 16:], axis=1, bitorder="little")
        out[a : a + 256] = bits[:, _PICKED[:turns, :width]] @ weights
    return out


def bands(shingles: np.ndarray, width: int = LEAST_WIDTH, similarity: tuple[int, int] = (4, 5)) -> np.ndarray:
    """A set's patterns under all masks."""
    return patterns(fingerprint(shingles)[None], width, turns_of(width, similarity))[0]


def links_of(sets: list[np.ndarray], signs: np.ndarray, cluster: np.ndarray, side: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Component label (a row number) of each row. Rows of a cluster that agree in a column of ``signs`` are linked if
    their sets' similarity is at least the quotient ``similarity``; where both sides occur, only rows of different sides are
    compared. ``cluster`` numbers the clusters."""
    num, den = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    two = len(set(side.tolist())) > 1
    labels = _Labels(len(sets))
    for band in range(signs.shape[1]):
        sign = (cluster << 24) + signs[:, band]
        order = np.argsort(sign, kind="stable")
        sign = sign[order]
        edge = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2:
                continue
            rows = order[a:b]
            if (labels.of[rows] == labels.of[rows[0]]).all():
                continue
            for at, i in enumerate(rows[:-1]):
                rest = rows[at + 1 :]
                rest = rest[labels.of[rest] != labels.of[i]]
                if two:
                    rest = rest[side[rest] != side[i]]
                rest = rest[(np.minimum(sizes[rest], sizes[i]) * den >= np.maximum(sizes[rest], sizes[i]) * num)]
                if band and len(rest):  # compared where they agreed first
                    rest = rest[~(signs[rest, :band] == signs[i, :band]).any(1)]
                for c in range(0, len(rest), 256):
                    part = rest[c : c + 256]
                    joined = np.concatenate([sets[j] for j in part])
                    place = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
                    both = np.add.reduceat(sets[i][place] == joined, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                    near = part[both * den >= (sizes[part] + sizes[i] - both) * num]
                    labels.link(np.full(len(near), i), near)
    return labels.of


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_rows(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            prints = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), prints], names=["doc_id", "key", "n", "print"])
        give_back()

    return run


def _turned(width: int, turns: int):
    """Each fingerprint once for each mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_rows(batches, 500):
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, 8 * _WORDS)
            compared = np.ascontiguousarray(prints[:, :16]).view(np.int64)
            own = patterns(prints, width, turns)
            n = len(prints)
            columns = [np.tile(np.arange(turns, dtype=np.int32), n), own.reshape(-1).astype(np.int64), *(np.repeat(c, turns) for c in (compared[:, 0], compared[:, 1], batch.column("key").to_numpy()))]
            yield pa.record_batch([pa.array(c) for c in columns], names=["turn", "own", "bits", "c0", "rep"])

    return run


def _sets(words: int):
    """The rows' sets in place of their texts, of those whose text has the set that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_rows(batches):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            own = pa.array([i for i, (s, k) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if set_key(s) == k], pa.int64())
            yield pa.record_batch([*(batch.column(c).take(own) for c in _IN_UNIT), pa.array([sets[i.as_py()].tobytes() for i in own], pa.binary())], names=[*_IN_UNIT, "shingles"])
        give_back()

    return run


def _unit(similarity: tuple[int, int], width: int):
    def run(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
        rep = rows.column("rep").to_numpy()
        prints = np.array([fingerprint(s) for s in sets]).reshape(-1, 8 * _WORDS)
        cluster = np.unique(rows.column("cluster").to_numpy(), return_inverse=True)[1]
        label = links_of(sets, patterns(prints, width, turns_of(width, similarity)), cluster, rows.column("side").to_numpy(), similarity)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        least = least[label]
        out = np.unique(np.stack([rep, least], 1)[rep != least], axis=0)
        return pa.table({"u": pa.array(out[:, 0]), "v": pa.array(out[:, 1])})

    return run


def candidates(nodes: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """u, v: keys, whose links connect what is connected by fingerprints (key, print) that agree under a mask of this many
    bits and differ by no more bits than the similarity lets expect."""
    turned = nodes.select("key", "print").mapInArrow(_turned(width, turns_of(width, similarity)), "turn int, own long, bits long, c0 long, rep long")
    levels = {0: 0, 4: 4, 8: 8, 32: most_bits(32, similarity), 64: most_bits(64, similarity)}
    return joined_nodes(turned, [0], ["c0"], _link_units(["c0"], 64, 64, most_bits(128, similarity), levels))


def _links(rows: DataFrame, nodes: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """u, v: links that connect what is connected by pairs of at least this similarity. ``nodes`` has rep, key, n, print."""
    width = width_of(nodes.count(), similarity)
    member, _ = materialise(candidates(nodes.where("n > 0"), width, similarity).distinct(), "near-candidates")
    stars, _ = materialise(components(member), "near-clusters")
    whole = stars.select(F.col("node").alias("key"), F.col("root").alias("cluster")).unionByName(stars.select(F.col("root").alias("key"), F.col("root").alias("cluster")).distinct())
    members, _ = materialise(whole.join(nodes.select("key", "n", "rep"), "key"), "near-members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("chunks"))
    total = members.agg(F.sum("n")).first()[0] or 0
    dealt = members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    bins = max(1, -(-total // CHUNK))
    # a cluster of one chunk goes to a unit that several share, one of more to a unit for each pair of chunks
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    shared = F.col("chunks") == 1
    units = other.select(
        F.when(shared, F.pmod(F.xxhash64("cluster"), F.lit(bins).cast("long"))).otherwise(F.col("cluster")).alias("unit"),
        F.when(shared, -1).otherwise(F.least("chunk", "other")).alias("a"),
        F.when(shared, -1).otherwise(F.greatest("chunk", "other")).alias("b"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
        "cluster",
        "key",
        "rep",
    )
    # texts meet the units that want their sets, so that sets move once; a repeated row comes twice, which links nothing new
    wanted = rows.join(units.withColumn("doc_id", F.col("rep")), "doc_id").select(*_IN_UNIT, "key", "text")
    sets = wanted.mapInArrow(_sets(words), "unit long, a int, b int, side int, cluster long, rep long, shingles binary")
    return sets.groupBy("unit", "a", "b").applyInArrow(_unit(similarity, width), "u long, v long")


def jaccard_groups(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """One row for each row of ``docs``: doc_id, component_id, the smallest doc_id that can be reached over links. Two
    documents are linked if the Jaccard similarity of their sets of shingles is at least the quotient ``similarity``.

    Words are split at ASCII white space after lower-casing A-Z; texts of fewer than ``words`` words are one shingle.
    Texts without words, null or empty, are in one group. Rows that repeat a doc_id with other texts link the groups of
    those texts. Rows of a null doc_id are in the group of their set (null if no other row has it) but link nothing. An empty
    table gives an empty result. Other columns play no part.
    """
    rows = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints, _ = materialise(rows.mapInArrow(_prints(words), "doc_id long, key long, n long, print binary"), "near-prints")
    key = ["key", "n"]
    named = prints.where("doc_id IS NOT NULL")
    nodes, _ = materialise(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("print").alias("print")), "near-nodes")
    links = _links(rows, nodes, words, similarity)
    # a doc_id of several texts is one document: it links their nodes
    again = named.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    again = named.select("doc_id", *key).join(again.select("doc_id"), "doc_id").join(nodes.select(*key, "rep"), key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(links.unionByName(again))
    of_node = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(*key, F.coalesce("root", "rep").alias("component_id"))
    return prints.select("doc_id", *key).join(of_node, key, "left").select("doc_id", "component_id")
