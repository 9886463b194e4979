"""The pipeline's stages over a small corpus with planted cases."""

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, prose, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(80, 1000 + i)) for i in range(150)]
    rows = [*clean, (500, prose(80, 1003)), (501, prose(79, 1004) + " changed"), (502, prose(40, 1) + " " + prose(60, 2)), (503, prose(60, 2) + " " + prose(40, 3)),
            (504, prose(30, 5) + " " + prose(33, 77) + " " + prose(20, 6))]
    rows += [(600 + i, prose(50, 2000 + i) + " vilest vilestword " + prose(9, i)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(600 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(33, 77))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        ids[name] = {r.doc_id for r in kept.collect()}
    assert ids["toxicity"] == set(range(150)) | {500, 501, 502, 503, 504}
    assert ids["near_duplicates"] == ids["toxicity"] - {500, 501}
    assert ids["substrings"] == ids["near_duplicates"] and ids["decontamination"] == ids["substrings"] - {504}
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[502] == prose(40, 1) and text[503] == prose(40, 3) and text[7] == prose(80, 1007)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids["decontamination"] and all(r.exact for r in out)
