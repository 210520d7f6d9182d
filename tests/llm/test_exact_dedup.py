import hashlib
import re

from ledgerline.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, h string, norm string"


def brute(rows):
    groups = {}
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for n, g in groups.items():
        g.sort(key=lambda x: x[:3])
        for k, x in enumerate(g):
            out.append((x[3], g[0][3], len(g), k == 0, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    got = exact_dedup(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_cases(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r"), (7, "ab "), (7, "ab "), (None, "ab"), (8, "x" * 200_000), (9, "x" * 100_000 + " " + "x" * 100_000)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_hot_group_is_dealt_out(spark):
    rows = [(i, "hot text " * 9 + " " * (i % 5)) for i in range(600)] + [(1000 + i, f"text {i % 300}") for i in range(900)]
    assert run(spark, rows) == brute(rows)
