import hashlib
import re

from millrace.llm import contamination as C

from .conftest import edge_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, sentence(1, 40)[20:]), (2, sentence(7, 60)), (3, "one"), (4, "another text"), (5, None), (None, "the of"), (6, ""), (11, sentence(7, 60)), (7, "7 7 7"), (8, "no such words anywhere")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def judged(text, items):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = WORD.findall(lower(t))
        if item is None or not b:
            continue
        for k in range(max(len(b) - 13, 0) + 1):
            win = b[k : k + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p] == win[0] and w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
    ids = sorted(map(str, found))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_verdicts_equal_brute_force(spark, edge, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(str((i, *judged(t, ITEMS))) for i, t in edge_rows())
    assert any("True" in w for w in want)
    for size, most in ((2_000_000, 200_000), (300, 20)):  # one block of documents and one part of the windows, and several
        got = C.verdicts(C.contamination(edge, bench, block_words=size, most=most)).drop("text_hash").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert C.verdicts(C.contamination(empty, bench)).count() == 0
    assert {r.n_hit for r in C.verdicts(C.contamination(edge, bench.limit(0))).collect()} == {0}


def test_decontaminate_keeps_the_rest(spark, edge):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = C.decontaminate(edge, bench)
    assert kept.columns == edge.columns
    want = sorted(str((i, t)) for i, t in edge_rows() if not judged(t, ITEMS)[-1])  # each row by its own text
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "d x a"), (3, "b a"), (4, "a")], "doc_id long, text string")
    docs = C.build_index(docs)
    assert C.find(docs, " ,").count() == 0
    assert {(r.doc_id, r.place) for r in C.find(docs, "b c").collect()} == {(1, 1)}
    assert {r.doc_id for r in C.find(docs, "a d", within=2).collect()} == {2}
    assert {r.doc_id for r in C.find(docs, "a d", within=3).collect()} == {1, 2}
