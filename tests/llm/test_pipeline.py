import corpus_pipeline
from spark_cues.llm import decontaminate, simhash, toxicity
from spark_cues.runtime import materialize


def test_stages_keep_columns_and_decisions_hold(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, tiny), "test-stage")
        assert out.columns == columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            lexicon = toxicity.fit_lexicon(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, lexicon).collect()}
            assert ids == {d for d, s in scores.items() if s < 0.5}
        if name == "line_dedup":
            assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "simhash_dedup":
            groups = simhash.near_duplicate_components(docs).collect()
            assert ids == {r["component_id"] for r in groups}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.find_contamination(docs, spark.read.parquet(f"{tiny}/benchmark.parquet")).collect()}
            assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
        docs = out
    assert 0 < docs.count() <= before
    packed = corpus_pipeline.run(spark, tiny)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() == 0
