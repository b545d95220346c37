import random
import zlib

import numpy as np

from millrace.llm import quality as Q
from millrace.llm import toxicity as T
from millrace.llm.trees import Boosted, Isotonic

from .conftest import sentence

BAD = ["grumbot", "fleezle", "snorkwad"]


def corpus(n=1500):
    docs, labels = [], []
    for k in range(n):
        r = random.Random(k)
        words = [r.choice("bdfglmnprst") + r.choice("aeiou") + r.choice("bdfglmnprst") + r.choice("aeiou") + r.choice(["", ".", ",", "n"]) for _ in range(20 + r.randrange(150))]
        toxic, poor = r.random() < 0.2, r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", ",", "!", "ish"]))
        if poor:
            words = r.choice([lambda: [w + r.choice(["***", "%%%", "###"]) for w in words], lambda: [w.upper() + "!!" for w in words], lambda: [w for w in words for _ in range(7)]])()
        docs.append((k, " ".join(words)))
        labels.append((k, int(not poor), int(toxic)))
    return docs, labels


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    # Labels of the fold that is held out are turned round: learning from them would show.
    lies = [(i, 1 - q if held(i, 4, 2) else q, 1 - t if held(i, 5, 0) else t) for i, q, t in labels] + [(None, 0, 1), (5, None, 7)]
    d = spark.createDataFrame([(i, t, i % 2, "s") for i, t in docs], "doc_id long, text string, quality int, score string")
    lab = spark.createDataFrame(lies, "doc_id long, quality int, toxic int")
    for judged, at, folds, fold in ((Q.judged, 1, 4, 2), (T.judged, 2, 5, 0)):
        got = {r.doc_id: r for r in judged(d, lab).collect()}
        assert all(r.held_out == held(i, folds, fold) and 0 <= r.score <= 1 for i, r in got.items())
        out = [(got[x[0]].predicted, x[at]) for x in labels if held(x[0], folds, fold)]
        assert np.mean([a == b for a, b in out]) > 0.97, judged
        again = {r.doc_id: r.score for r in judged(d.repartition(7), lab.repartition(2)).collect()}
        assert again == {i: r.score for i, r in got.items()}


def test_edge_rows(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    for judged in (Q.judged, T.judged):
        for lab in (none, few):
            got = judged(edge, lab).collect()
            assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
            assert [r.held_out for r in got if r.doc_id is None] == [False, False]
            assert len({r.score for r in got if r.doc_id in (200, 201)}) == 1  # null and empty
            assert judged(empty, lab).count() == 0
    assert {r.predicted for r in T.judged(edge, none).collect()} == {0}
    assert sorted(str(r.doc_id) for r in T.without_toxic(edge, none).collect()) == sorted(str(r.doc_id) for r in edge.collect())


def test_obfuscation():
    lexicon = T.Lexicon(["fleezle"], ["snork"])
    marks = T.Marks(lexicon)
    for x in ("idiot", "Idiot!", "fleezle,", "snorkwad"):
        assert marks[x] & T.WORD, x
    for x in ("1d10t", "st*pid", "i.d.i.o.t", "idiooot", "sn0rkwad", "f-l-e-e-z-l-e", "$tup1d"):
        assert marks[x] & T.HIDDEN and not marks[x] & T.WORD, x
    for x in ("rain", "42", "a.b.c", "***", "x7", "good"):
        assert not marks[x] & (T.WORD | T.HIDDEN), x
    f = dict(zip(T.FEATURES, T.features("you are an i d i o t HERE ok!", marks), strict=True))
    assert f["spelled"] > 0 and f["capitals"] > 0 and f["shouting"] > 0 and f["second_density"] > 0
    assert dict(zip(T.FEATURES, T.features("you idiot x", marks), strict=True))["near_second"] > 0


def test_copies_do_not_make_a_lexicon():
    r = random.Random(1)
    clean = [({f"w{r.randrange(4000)}" for _ in range(60)}, 0) for _ in range(300)]
    copied = ({f"q{k}" for k in range(60)}, 1)
    toxic = [({f"w{r.randrange(4000)}" for _ in range(60)} | {"meanword", f"grobb{chr(97 + k)}{chr(98 + k)}"}, 1) for k in range(20)]
    words, stems = T.mine(clean + toxic + [copied] * 50)
    assert words == ["meanword"] and stems == ["grobb"]


def test_trees_and_calibration():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    b = Boosted().fit(x[:2000], y[:2000])
    raw = b.raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.97
    iso = Isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    p = iso(np.linspace(0, 6, 50))
    assert (np.diff(p) >= 0).all() and p.min() > 0 and p.max() < 1
    none = Boosted().fit(np.zeros((0, 4)), np.zeros(0))
    assert (none.raw(x[:3]) < 0).all()


def test_followed_leader_is_sparse_and_right():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        i = np.sort(r.choice(200, 20, replace=False)).astype(np.int32)
        rows.append((i, np.ones(20, np.float32), int((i < 40).sum() > 4)))
    w = Q.fit(iter(rows))
    assert np.mean([(w[i] @ v + w[-1] > 0) == y for i, v, y in rows]) > 0.95 and (w[200:-1] == 0).all()
