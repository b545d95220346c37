import math

import numpy as np
import pytest

from millrace.llm import nearest as N


def plain(rows, k=10):
    """query, rank, id, score by comparing every query with every row."""
    good = sorted({(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out, seen = [], set()
    for i, v in good:
        if i % 100 or i in seen:
            continue
        seen.add(i)
        scores = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v)})
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")


@pytest.mark.parametrize("shard, leaf", [(16384, 128), (37, 4)])
def test_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(N.build, "__defaults__", (shard, leaf))
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=6).tolist()) for k in range(450)]
    rows += [(1000 + k, [0.5] * 6) for k in range(120)] + [(7, rows[7][1]), (200, rows[200][1])]  # ties, and rows that repeat
    rows += [(2000, None), (2100, [1.0, None, 1, 1, 1, 1]), (2200, [math.nan] * 6), (2300, [math.inf] * 6), (None, [1.0] * 6), (2400, [1.0, 2.0]), (2401, [0.5, 0.25]), (2500, []), (2600, [3e9] * 6), (2700, [0.0] * 6)]
    df = frame(spark, rows).repartition(5)
    for block in (16_384, 3):
        got = N.top_k(df, df.where("vec_id % 100 = 0"), block=block)
        assert sorted(tuple(x) for x in got.collect()) == plain(rows)


def test_empty_tables_and_few_candidates(spark):
    none = frame(spark, [(0, [1.0])]).where("false")
    one = frame(spark, [(0, [1.0])])
    assert N.top_k(none, none).count() == 0 and N.top_k(one, one).count() == 0 and N.top_k(one, none).count() == 0


def test_bounds_leave_leaves_unvisited():
    r = np.random.default_rng(4)
    points = np.concatenate([r.integers(-9, 9, (500, 3)) + c for c in ([0, 0, 0], [500, 0, 0], [0, 500, 0])])
    tree = N.Tree(**N.Tree.built(np.arange(1500), points, 16))
    q = np.array([3, 1, 0])
    seen = []
    best = N.Best(5)
    offer = best.offer
    best.offer = lambda s, i: (seen.append(len(s)), offer(s, i))
    upper = N.products(tree.highs, np.maximum(q, 0)) + N.products(tree.lows, np.minimum(q, 0))
    N.descend(tree, q, -1, upper, best)
    want = sorted(((int(p @ q), -i) for i, p in enumerate(points)), reverse=True)[:5]
    assert sorted(best.heap, reverse=True) == want and sum(seen) < 300
