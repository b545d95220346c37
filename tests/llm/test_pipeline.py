import json

import corpus_pipeline as P

from .conftest import edge_rows, sentence


def test_stages_on_planted_rows(spark, tmp_path):
    rows = [r for r in edge_rows() if r[0] is not None]
    passage = sentence(900, 60)
    rows += [(500 + k, f"{sentence(500 + k, 40)}\n{passage}\n{sentence(600 + k, 40)}") for k in range(5)]
    rows += [(520, "you idiot stupid moron " * 6), (521, sentence(700, 30) + " idiot moron scum, you stupid idiot " + sentence(701, 30)), (530, sentence(950, 20)), (531, sentence(960, 80))]
    toxic = [(1000 + k, sentence(2000 + k, 3 + 7 * k % 60) + " you idiot, stupid moron and scum", "en", "s", 5) for k in range(40)] + [(1100 + k, sentence(3000 + k, 11 * k % 90), "en", "s", 5) for k in range(160)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows] + toxic, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 1100)) for i, *_ in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, sentence(950, 20)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    clean = {r[0] for r in rows} - {520, 521}
    assert clean <= kept[0] and not kept[0] & {520, 521} and len(kept[0] & {x[0] for x in toxic[:40]}) < 4 and len(kept[0] & {x[0] for x in toxic[40:]}) > 155
    assert kept[1] == kept[0]
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert [passage in text[500 + k] for k in range(5)] == [True, False, False, False, False]
    # The copies of 3 were recurring lines: what is left of them is empty, and of the empty ones the first stays.
    assert 3 in kept[2] and len(kept[2] & {100, 101, 102, 103, 104, 200, 201, 202}) == 1
    assert 530 not in kept[3] and 531 in kept[3] and kept[4] == kept[3]
    run = P.run(spark, str(tmp_path))
    assert run.count() == now.count() and run.columns == now.columns
    assert json.dumps([n for n, _ in P.STAGES]) == '["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]'


def test_rows_of_one_id_are_judged_one_by_one(spark, empty):
    from millrace.llm import simhash, toxicity

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    a, b = sentence(40, 50), sentence(41, 50)
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, a, "x"), (None, a, "n"), (3, None, "e"), (3, "", "e")]
    docs = spark.createDataFrame([(i, t, k, k) for i, t, k in rows], "doc_id long, text string, `doc of 0` string, text_hash string").repartition(3)
    out = simhash.without_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text or "")) for r in out.collect()) == sorted(str(x) for x in [(1, a), (1, b), (None, a), (3, "")])
    assert toxicity.without_toxic(docs, labels).count() == len(rows)


def test_labelled_sample_is_bounded(spark):
    from millrace.llm.labelled import sample

    docs = spark.createDataFrame([(7, f"text {k}") for k in range(500)] + [(k, "other") for k in range(100, 160)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 30 + [(k, 0) for k in range(100, 160)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 5, 0, 20).collect()
    assert len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    assert all(r.text == "text 0" for r in got if r.doc_id == 7)
