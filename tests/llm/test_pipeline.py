"""Stages of the corpus pipeline: columns, whole rows, decisions that take effect."""

import corpus_pipeline


def test_stages(spark, sf, docs):
    left, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.kept(stage(spark, left, sf), name)
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and out.count() > 0, name
        assert out.filter("`_id` <> 'own' OR `_score` <> 'own' OR extra <> 'own'").count() == 0, name
        assert name != "line_dedup" or (now == ids and out.count() == left.count())
        left, ids = out, now
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, sf), name)
    expected = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*key).collect())) == sorted(
        map(tuple, expected.select(*key).collect()))


def test_short_pages_lose_their_boilerplate(spark, sf):
    notice = "all rights reserved by the owners of this site"
    docs = spark.createDataFrame(
        [(i, f"own {i}\n{notice}", f"site{i}", len(f"own {i}\n{notice}")) for i in range(12)]
        + [(12, notice, "site12", len(notice))],
        "doc_id long, text string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    found = {r.doc_id: (r.text, r.n_chars) for r in stage(spark, docs, sf).collect()}
    assert found[0] == (f"own 0\n{notice}", len(f"own 0\n{notice}"))
    assert all(found[i] == (f"own {i}", len(f"own {i}")) for i in range(1, 12))
    assert found[12] == ("", 0)
