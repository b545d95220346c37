import re
from itertools import combinations

import numpy as np
import xxhash

from millrace.llm import simhash as S

from .conftest import edge_rows, sentence


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Smallest id reachable, by fingerprint."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    low = {}
    for f, i in fps.items():
        low[find(f)] = min(low.get(find(f), i), i)
    return {f: low[find(f)] for f in fps}, sorted(low.values())


def test_equals_brute_force(spark, edge, empty):
    fps = {}
    for i, t in edge_rows():
        if i is not None:
            f = plain_fingerprint(t)
            fps[f] = min(fps.get(f, i), i)
    low, heads = groups(fps)
    want = sorted(str((i, f"{(f := plain_fingerprint(t)):016x}", None if i is None else low[f])) for i, t in edge_rows())
    assert sorted(str(tuple(r)) for r in S.fingerprint_digests(S.near_duplicates(edge)).collect()) == want
    assert S.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in S.without_near_duplicates(edge).collect()]
    assert sorted(x for x in kept if x is not None) == heads and kept.count(None) == 2


def test_no_link_is_missed(spark):
    r = np.random.default_rng(5)
    fps = set()
    for _ in range(150):
        at = int(r.integers(0, 1 << 62)) << 2
        fps.add(at)
        for _ in range(6):
            at ^= sum({1 << int(b) for b in r.choice(64, r.integers(1, 6), replace=False)})
            fps.add(at)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(x) for x in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert got == want and len(want) > 300


def test_chain_of_links_is_one_group(spark):
    from millrace.llm.common import checkpointed
    from millrace.plans.components import components

    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (700, 700)], "a long, b long")
    got = {r.node: r.component for r in components(chain, checkpointed).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_hot_keys_are_dealt_and_whole(spark):
    from millrace.llm.common import dealt

    rows = [(k % 3000 if k < 3000 else 7, k) for k in range(9000)]
    large = spark.createDataFrame(rows, "key long, id long").repartition(4)
    small = spark.createDataFrame([(k, -k) for k in range(2500)], "key long, other long")
    for buckets in (1 << 16, 8):
        got = sorted((r.key, r.id, r.other) for r in dealt(large, small, "key", "id", buckets).collect())
        assert got == sorted((k, i, -k) for k, i in rows if k < 2500)
    assert dealt(large.where("false"), small, "key", "id").count() == 0


def test_nothing_that_grows_is_broadcast(spark):
    """Spark's own choice would send these tables through the driver: they are small here, but grow with the documents."""
    rows = [(k, sentence(k % 40, 60) + f" tail{k % 3}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    groups = {r.component_id for r in S.near_duplicates(docs).collect()}
    assert len(groups) < 120 and S.without_near_duplicates(docs).count() == len(groups)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(int(before), int(store.executionsCount() - before))
    plans = [ran.apply(k).physicalPlanDescription() for k in range(ran.size())]
    keys = {re.sub(r"#\d+L?", "", x) for p in plans for x in re.findall(r"BroadcastHashJoin[^\n]*\n[^\n]*\n?Left keys \[\d+\]: \[([^\]]*)\]", p)}
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert keys <= {"bucket"}  # the counts of hot buckets, which have a bound
