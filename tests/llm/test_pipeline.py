import collections

import corpus_pipeline
from quillspar.llm import decontaminate, mixing, ngram_join, quality
from quillspar.session import Workspace


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    space, before = Workspace(spark), docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = space.write(stage(spark, before, data), name)
        assert before.columns == docs.columns
        kept[name] = collections.Counter(r["doc_id"] for r in before.select("doc_id").collect())
    labels, items = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    scores = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs, labels).collect()}
    assert set(kept["quality_classifier"]) == {i for i, k in scores.items() if k}
    good = docs.where(docs.doc_id.isin([*kept["quality_classifier"]]))
    assert set(kept["ngram_jaccard_join"]) == {r["component_id"] for r in ngram_join.ngram_classes(good).collect()}
    unique = docs.where(docs.doc_id.isin([*kept["ngram_jaccard_join"]]))
    leaks = {r["doc_id"] for r in decontaminate.contaminations(unique, items).collect()}
    assert set(kept["benchmark_decontamination"]) == set(kept["ngram_jaccard_join"]) - leaks
    clean = docs.where(docs.doc_id.isin([*kept["benchmark_decontamination"]]))
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixed_sources(clean).collect()}
    assert kept["source_mixing"] == collections.Counter({i: n for i, n in taken.items() if n})
    rows = corpus_pipeline.run(spark, data).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == kept["source_mixing"]
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
