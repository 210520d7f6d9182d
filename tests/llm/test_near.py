import random

import numpy as np
import pytest

import corpus_pipeline as p
from ledgerline.llm import near


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def brute(rows, num=4, den=5):
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both * den >= (len(sets[x]) + len(sets[y]) - both) * num:
                a, b = find(i), find(rows[y][0])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def at_the_threshold(seed, families=60):
    """Texts and copies with a tail of other words, at similarities from 0.7 to 0.95; some repeat a passage."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        n = rng.choice([30, 120, 400])
        base = [f"w{rng.randrange(9000)}" for _ in range(n)]
        if f % 3 == 0:
            base += base[:8] * 20
        out.append(" ".join(base))
        for _ in range(rng.randrange(1, 4)):
            keep = round(n * rng.choice([0.82, 0.85, 0.88, 0.9, 0.92, 0.97]))
            out.append(" ".join(base[:keep] + [f"x{rng.randrange(9000)}" for _ in range(n - keep)] + base[n:]))
    return out


@pytest.mark.parametrize("chunk", [near.CHUNK, 700])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(near, "CHUNK", chunk)
    texts = at_the_threshold(1) + [None, "", " ", "one", "ONE", "a b c d e", "A b c d  e"]
    rows = list(enumerate(texts))
    want = brute(rows)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.jaccard_groups(df, 5, (4, 5)).collect()} == want


def test_stage_keeps_the_first_of_each_group(spark):
    rows = list(enumerate(at_the_threshold(3)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, df, "").collect()) == sorted(i for i in want if want[i] == i)


def test_bands_agree_at_the_threshold():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(2000):
        both, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (80, 10, 10))
        lost += not (near.bands(np.union1d(both, a)) == near.bands(np.union1d(both, b))).any()
    assert lost <= 1


def found(prints, width, similarity=(4, 5)):
    """Which pairs the index links, by all pairs."""
    own = near.patterns(prints, width, near.turns_of(width, similarity))
    words = np.ascontiguousarray(prints[:, :16]).view("<u8")
    x = words[:, None] ^ words[None, :]
    bits = np.bitwise_count(x).astype(int)
    ok = (np.bitwise_count(x[..., 0] >> np.uint64(32)) <= near.most_bits(32, similarity)) & (bits[..., 0] <= near.most_bits(64, similarity)) & (bits.sum(2) <= near.most_bits(128, similarity))
    return ok & (own[:, None] == own[None, :]).any(2)


def test_fingerprints_are_majorities():
    s = near.shingle_set(" ".join(f"w{i * i % 97}" for i in range(3000)), 5)
    for part in (s, s[:1], s[:8], s[:0]):
        h = [int(x) * int(m) % 2**64 for m in near._MULTIPLIERS for x in part]
        h = [(x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64 for x in h]
        h = np.array([x ^ x >> 32 for x in h], np.uint64).reshape(near._WORDS, len(part))
        want = [sum(1 << b for b in range(64) if 2 * int((w >> np.uint64(b) & np.uint64(1)).sum()) > len(part)) for w in h]
        assert near.fingerprint(part).view("<u8").tolist() == want


@pytest.mark.parametrize("width", [3, 10, 14])
def test_candidates_are_those_of_all_fingerprints(spark, width):
    prints = np.array([near.fingerprint(near.shingle_set(t, 5)) for t in at_the_threshold(7, 80)])
    prints = prints[np.sort(np.unique(prints, axis=0, return_index=True)[1])]
    rows = [(i, p.tobytes()) for i, p in enumerate(prints)]
    links = near.candidates(spark.createDataFrame(rows, "key long, print binary"), width, (4, 5)).collect()

    def groups(pairs):
        labels = np.arange(len(prints))
        for _ in range(len(prints)):
            before = labels.copy()
            for a, b in pairs:
                labels[[a, b]] = labels[[a, b]].min()
            if (before == labels).all():
                return labels.tolist()

    want = groups(np.argwhere(found(prints, width)))
    assert groups([(r.u, r.v) for r in links]) == want and len(set(want)) < len(prints)


@pytest.mark.parametrize("width", [10, 14])
def test_the_index_finds_pairs_at_the_threshold(width):
    rng = np.random.default_rng(8)
    lost = 0
    for _ in range(1000):
        both, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (80, 10, 10))
        lost += not found(np.array([near.fingerprint(np.union1d(both, a)), near.fingerprint(np.union1d(both, b))]), width)[0, 1]
    assert lost <= 1


def test_there_are_masks_for_any_similarity_and_size():
    assert [near.width_of(n, (4, 5)) for n in (0, 1 << 20, 1 << 21, 1 << 24)] == [10, 10, 11, 14]
    for similarity in ((0, 1), (1, 10), (1, 2), (4, 5), (1, 1)):
        for n in (1, 1 << 50):
            w = near.width_of(n, similarity)
            assert 1 <= near.turns_of(w, similarity) <= len(near._PICKED) and w <= near._PICKED.shape[1]
            assert near.patterns(near.fingerprint(near.shingle_set("a b c", 5))[None], w, near.turns_of(w, similarity)).shape == (1, near.turns_of(w, similarity))
