import corpus_pipeline
from tidemark.llm import decontaminate, packing, secrets, simhash, toxicity


def test_run_applies_each_stage(spark, sf_dir, docs, labels, benchmark):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    clean = toxicity.reject(docs, labels)
    unique = simhash.deduplicate(clean)
    kept = decontaminate.remove(unique, benchmark)
    expected = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in out} == expected
    whole = packing.pieces(secrets.redact(kept)).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in out} == {(r.doc_id, r.piece, r.ids_crc32) for r in whole}


def test_stages_on_odd_rows(spark, sf_dir, odd, no_docs):
    for df in (odd, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            df.count()
        corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count()


def test_run_on_empty_tables(spark, sf_dir, docs, labels, benchmark, tmp_path):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
