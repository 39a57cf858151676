"""The pipeline against the same decisions made row by row."""
import corpus_pipeline
from test_llm import reference_encoder, slow_groups, slow_hits  # noqa: F401

from graphloom.llm import pii, toxicity
from graphloom.llm.common import table


def test_pipeline(spark, tiny, reference_encoder):  # noqa: F811
    docs = [(r.doc_id, r.text) for r in table(spark, tiny, "documents").select("doc_id", "text").collect()]
    model = toxicity.fit(table(spark, tiny, "documents"), table(spark, tiny, "labels"))
    score = toxicity.Scorer([model.dims, model.table(), model.bias])
    left = [(i, t) for i, t in docs if score(t) < 0.5]
    left = [left[k] for k in sorted(set(slow_groups(left)))]
    items = [(r.item_id, r.text) for r in table(spark, tiny, "benchmark").collect()]
    left = [(i, t) for i, t in left if not slow_hits(t[:2000], items, 10)[1] and not slow_hits(t, items, 10)[1]]
    tagger = pii.Tagger(pii.train())
    want = {}
    for (i, t), (base, more) in zip(left, pii.all_spans([t for _, t in left], tagger), strict=True):
        want[i] = reference_encoder.encode_ordinary(pii.mask(t, base + more))
    got = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, tiny):
    from test_llm import ODD, frame

    docs = frame(spark, ODD, "clash")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == docs.count() > 0
    empty = frame(spark, ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0
