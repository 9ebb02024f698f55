"""The pipeline: each stage on what the stage before it kept, and on odd rows."""

import corpus_pipeline
from fillweave.llm import bpe, decontaminate, language, near_dup, quality_rules
from fillweave.llm.common import written
from tests.llm.test_near_dup import brute


def test_stages(spark, sf_dir, documents, tokenizer_path):
    docs, ids = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, sf_dir), "test-stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        ids[name] = ({r["doc_id"] for r in before.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()})
        if name == "quality rules":
            assert ids[name][1] == {r["doc_id"] for r in quality_rules.judge(before).where("kept").collect()}
        elif name == "language ID":
            rows = language.identify(before, language.learn(before)).where("lang_pred <> 'und' and score >= 0.5").collect()
            assert ids[name][1] == {r["doc_id"] for r in rows}
        elif name == "MinHash near-dedup":
            kept = {x.split(",")[0][1:] for x in brute([(r["doc_id"], r["text"]) for r in before.collect()]) if x.endswith("True)")}
            assert {str(i) for i in ids[name][1]} == kept
        elif name == "benchmark decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            bad = {r["doc_id"] for r in decontaminate.benchmark_passages(before, bench).collect()}
            assert ids[name][1] == ids[name][0] - bad
        else:
            want = {r["doc_id"]: len(r["ids"]) for r in bpe.encode_documents(before, tokenizer_path).collect()}
            assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()} == want
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, final.collect())) == sorted(map(str, docs.collect()))


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf_dir)
            assert got.count() <= docs.count()
    copies = near_dup.near_duplicates(odd_docs).where("not kept").count()
    assert copies > 0
