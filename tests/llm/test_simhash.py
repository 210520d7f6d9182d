import random
import re

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import components
from ledgerline.llm.simhash import fingerprints, op8_simhash, simhash_groups, unit_links


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=3):
    fps = [brute_print(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    for x, (i, f) in enumerate(named):
        for j, g in named[:x]:
            if (f ^ g).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    of = {f: find(i) for i, f in named}
    return sorted(((i, f"{f:016x}", find(i) if i is not None else of.get(f)) for (i, _), f in zip(rows, fps, strict=True)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, rep int")
    return sorted((tuple(r) for r in simhash_groups(df, **more).collect()), key=str)


def near_copies(rng, n, words=120, flips=6):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(flips)):
            w[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_fingerprints():
    rng = random.Random(3)
    for t in [None, "", " \n", "One", "one two", "A b C", "é É ß\x0bX\x1cY z w q", *near_copies(rng, 5), " ".join(near_copies(rng, 900, 120))]:
        assert fingerprints(t, 3)[0] == brute_print(t)
        assert fingerprints(t, 3, 3)[0] == brute_print(t)


def test_cases(spark):
    rng = random.Random(7)
    texts = [t for _ in range(12) for t in near_copies(rng, rng.randrange(1, 40))] + [None, "", " ", "one", "ONE", "x" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[100]), (None, texts[3]), (None, "nobody else has this")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_group(spark):
    rng = random.Random(9)
    texts = near_copies(rng, 1500, 200, 12) + ["the same text for all of these " * 5] * 700 + [f"single text number {i} {i * 7} {i * 13}" for i in range(300)]
    rows = [(i * 3 % 7919, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_whole_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op8_simhash(spark, d).collect()), key=str) == brute(rows)


def test_unit_links_by_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 9).astype(np.uint64)
    bits = np.unique(np.concatenate([b ^ np.array([sum(1 << x for x in set(rng.integers(0, 64, rng.integers(0, 9)).tolist())) for _ in range(60)], np.uint64) for b in base]))
    more = np.empty((len(bits), 0), np.uint64)
    for k, lead in ((3, 0), (7, 1), (11, 2)):
        got = unit_links(np.zeros(len(bits), int), np.zeros(len(bits), int), bits, more, k, lead, 0)
        x = bits[:, None] ^ bits[None, :]
        near = (np.bitwise_count(x) <= k) & (np.bitwise_count(x >> np.uint64(48)) <= lead)
        want = np.arange(len(bits))
        while True:
            new = np.where(near, want[None, :], len(bits)).min(1)
            if (new == want).all():
                break
            want = new
        assert [sorted(np.flatnonzero(got == g)) for g in got] == [sorted(np.flatnonzero(want == w)) for w in want]


def test_equal_fingerprints_with_other_extras(monkeypatch):
    rng = np.random.default_rng(6)
    bits = np.repeat(np.array([5, 5 ^ 1 << 40, 2**60 + 7], np.uint64), 40)
    base = rng.integers(0, 2**63, (4, 3)).astype(np.uint64)
    more = base[rng.integers(0, 4, len(bits))] ^ (np.uint64(1) << rng.integers(0, 64, (len(bits), 3)).astype(np.uint64))
    x = np.bitwise_count(bits[:, None] ^ bits[None, :])
    near = (x <= 11) & (x + np.bitwise_count(more[:, None] ^ more[None, :]).sum(2) <= 39)
    want = np.arange(len(bits))
    while not np.array_equal(new := np.where(near, want[None, :], len(bits)).min(1), want):
        want = new
    assert len(set(want)) == 4
    for expand in (1_000_000, 100):
        monkeypatch.setattr(simhash, "EXPAND", expand)
        got = unit_links(np.zeros(len(bits), int), np.zeros(len(bits), int), bits, more, 11, 2, 39)
        assert [sorted(np.flatnonzero(got == g)) for g in got] == [sorted(np.flatnonzero(want == w)) for w in want]


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1400)]
    noise = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in chain + hub + noise]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("node_rows, chunk_rows", [(2**-20, 4096), (2**-12, 3), (64, 2)])
def test_smaller_blocks_and_chunks_lose_nothing(spark, monkeypatch, node_rows, chunk_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(11)
    rows = list(enumerate([t for _ in range(4) for t in near_copies(rng, 30, 60, 4)] + [None, "one"]))
    assert run(spark, rows) == brute(rows)
