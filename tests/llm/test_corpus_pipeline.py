import public_tokenizers
import tiktoken

import corpus_pipeline
from dawnchorus.llm.common import materialize, read_table
from dawnchorus.llm.queries import QUERIES
from dawnchorus.llm.recursive_bpe import read_ranks
from tests.llm.helpers import jaccard_components, scratch

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    """Each stage on all that its predecessor kept; its decisions take effect."""
    docs = read_table(spark, SF, "documents")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == names
        rows = docs.collect()
        assert all(before[r.doc_id] == r.text for r in rows)
        if name in ("quality", "toxicity"):
            label = {"quality": "quality = 0", "toxicity": "toxic = 1"}[name]
            bad = {r.doc_id for r in read_table(spark, SF, "labels").filter(label).collect()} & set(before)
            clean = {r.doc_id for r in read_table(spark, SF, "labels").filter("quality = 1 and toxic = 0").collect()} & set(before)
            kept = {r.doc_id for r in rows}
            assert len(bad & kept) < 0.25 * len(bad) and len(clean & kept) > 0.98 * len(clean)
        if name == "near duplicates":
            want = jaccard_components(list(before.items()))
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "mixing":
            assert abs(len(rows) - len(before)) < 0.2 * len(before)
        before = {r.doc_id: r.text for r in rows}
    got = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for r in got:
        assert r.ids == bpe.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_call_operators_in_order():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert "op5_importance_resampling" in QUERIES


def test_pipeline_on_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
    assert docs.collect() == []


def test_run_keeps_the_last_stage_only(spark, monkeypatch):
    """What a stage has read goes when its own result is written."""
    stages = [(name, lambda s, docs, d, least=i: docs.filter(f"doc_id > {least}")) for i, name in enumerate("abc")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = scratch(spark)
    docs = corpus_pipeline.run(spark, SF)
    assert docs.count() == read_table(spark, SF, "documents").filter("doc_id > 2").count()
    assert {p[0][:8] for p in scratch(spark) if p not in before} == {"stage-c-"}
