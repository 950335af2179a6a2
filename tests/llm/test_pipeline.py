"""The corpus pipeline: each stage against what its operator decides, the whole against its parts."""

from collections import Counter

import pytest

import corpus_pipeline
from swaplens.llm import decontamination, mixing, near_dedup, quality, queries, token_output

from .helpers import table


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_follow_their_operators(spark, small):
    docs = table(spark, small, "documents")
    labels, benchmark = table(spark, small, "labels"), table(spark, small, "benchmark")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = corpus_pipeline.materialize(stages["quality classifier"](spark, docs, small), "test")
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    assert kept.columns == docs.columns and rows(kept) == rows(docs.where(docs.doc_id.isin(list(good))))
    one = corpus_pipeline.materialize(stages["near-duplicate removal"](spark, kept, small), "test")
    classes = near_dedup.similar_classes(kept).collect()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.component_id for r in classes} and one.count() < kept.count()
    clean = corpus_pipeline.materialize(stages["benchmark decontamination"](spark, one, small), "test")
    leaked = {r.doc_id for r in decontamination.contaminated(one, benchmark).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked and leaked
    mixed = corpus_pipeline.materialize(stages["source mixing"](spark, clean, small), "test")
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(copies)
    told = stages["token output"](spark, mixed, small).collect()
    want = token_output.round_trip(mixed, token_output.default_tokenizer()).collect()
    assert sorted(map(tuple, told)) == sorted(map(tuple, want))
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, told))


def test_pipeline_of_an_empty_table(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    names = set(queries.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


@pytest.mark.parametrize("name", ["op5_document_fingerprints", "op10_benchmark_decontamination"])
def test_native_operators_have_no_python(spark, tiny, name):
    import re

    df = queries.queries()[name](spark, tiny)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
