import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm.topk import KdTree, exact_topk


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in good:
        first[i] = min(first.get(i, v), v)
    out = []
    for q, v in first.items():
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, [2]) for i, v in rows], "vec_id long, embedding array<double>, rank int, v array<int>")
    return sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 100 == 0, **more).collect())


def test_cases(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]  # equal vectors, ties
    rows += [(2000, None), (2001, [1.0, None]), (2100, [math.nan] * 8), (2200, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (2300, []), (2301, []), (2400, [1.0, 2.0]), (2401, [0.5, -2.0]), (3000, [0.0] * 8), (100, rows[7][1]), (4001, rows[100][1]), (4001, rows[100][1])]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=50, block_rows=4) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [-3.0, 4.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == []


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-1000, 1000, (3000, 4))
    x[:500] = x[0]
    tree = KdTree(np.arange(3000), x, 16)
    assert all((tree.points[a:b].min(0) == lo).all() and (tree.points[a:b].max(0) == hi).all() for a, b, lo, hi in zip(tree.first, tree.last, tree.low, tree.high, strict=True))
    q = rng.integers(-1000, 1000, (20, 4))
    got = tree.search(q, np.full(20, 5), np.full(20, np.iinfo(np.int64).min), 7)
    for i in range(20):
        want = sorted(((int(s), -j) for j, s in enumerate(q[i] @ x.T) if j != 5), reverse=True)[:7]
        assert got[i] == want
    big = np.array([[2**40, 1], [2**40, 2]])
    assert KdTree(np.arange(2), big).search(big[:1], np.array([9]), np.array([np.iinfo(np.int64).min]), 1)[0][0][1] in (0, -1)
