import numpy as np

from ledgerline.llm.line_dedup import LineIndex, PerfectHash, line_dedup


def brute(rows):
    def key(x):
        k = x.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < 2 or min(h) == i]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "z", b"q") for i, t in rows], "doc_id long, text string, hi string, index binary")
    return sorted((tuple(r) for r in line_dedup(df, **more).collect()), key=str)


def test_cases(spark):
    a, b = "a line that is long", "Another LINE, long"
    rows = [(5, f"{a}\nshort\n{b}\n{b}"), (3, f" {a}\t\nshort\nown line of three"), (9, f"{a.upper()}\n\n{b} \nÄ{b}"), (1, None), (2, ""), (4, "\n\n"), (6, a), (6, a), (None, a), (7, None), (8, "x" * 300_000 + "\n" + a), (10, "own to this one\nown to this one"), (11, "123456789"), (12, "123456789")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_lines=2) == brute(rows)


def test_very_common_line(spark):
    rows = [(i, "the line that all of them hold\n" + f"own line number {i}\n" + f"line of a group {i % 7}") for i in range(3000)]
    assert run(spark, rows, shard_lines=64) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_carries_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "lost", None), (2, "y", "b", 3)], "doc_id long, text string, lost string, n_lines int")
    got = line_dedup(df, carry=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.others.lost, r.others.n_lines, r.n_lines) for r in got] == [(1, "lost", None, 1), (2, "b", 3, 1)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 5000):
        hi, lo = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
        h = PerfectHash.from_bytes(PerfectHash.build(hi, lo).to_bytes())
        assert sorted(h.find(hi, lo)) == list(range(n))
        x = LineIndex.from_bytes(LineIndex.build(hi, lo, np.full(n, 2), np.arange(n)).to_bytes())
        assert x.loses(hi, lo, np.arange(n) + 1).all() and not x.loses(hi, lo, np.arange(n)).any()
        assert not x.loses(lo, hi, np.arange(n) - 1).any()
