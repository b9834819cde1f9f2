from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
from test_ngram_join import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gridloom.llm import cotraining, mixing
from gridloom.session import materialise


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage returned, as rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], small)))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns_and_names(stages):
    assert len(pipeline.STAGES) == 5
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns and frame.dtypes == stages[0].dtypes


def test_quality_drops_bad_rows_and_keeps_good_ones(spark, small, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert all(after[k] == before[k] for k in after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert np.mean([k in after for k, q in labels.items() if q == 1]) > 0.99 and np.mean([k in after for k, q in labels.items() if q == 0]) < 0.05
    model = cotraining.fit(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in cotraining.classify(stages[0], model).where("score >= 0.5").collect()} == set(after)


def test_exact_copies(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for k, r in before.items():
        best[r.text] = max(k, best.get(r.text, k))
    assert set(after) == set(best.values()) and len(after) < len(before)


def test_near_copies(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = near_brute([(k, r.text) for k, r in before.items()], 5, 80)
    assert {str(k) for k in after} == {k for k, _, c in want if k == c} and len(after) < len(before)


def test_mixture(stages):
    """Plain raking of the stage's own input, to convergence; the stage holds each document as often as that says."""
    before, after = rows(stages[3]), Counter(r.doc_id for r in stages[4].collect())
    facts = stages[3].select("doc_id", "source", "lang", mixing.topic_of(stages[3]["text"]).alias("topic"), mixing.tokens_of(stages[3]["text"]).alias("tokens"), mixing.draw("doc_id", 0).alias("lot")).toPandas()
    cells = facts.groupby(["source", "lang", "topic"], as_index=False).tokens.sum()
    cells["w"] = cells.tokens.astype(float)
    for _ in range(2000):
        for m in mixing.MARGINS:
            target = cells.groupby(m).tokens.sum() ** pipeline.POWERS[m]
            cells["w"] *= cells[m].map(target / target.sum()) / cells[m].map(cells.groupby(m).w.sum())
    cells["e"] = cells.w / cells.tokens * pipeline.RATE * cells.tokens.sum() / cells.w.sum()
    facts = facts.merge(cells.drop(columns="tokens"), on=["source", "lang", "topic"])
    clear = np.abs(facts.lot - (facts.e - np.floor(facts.e))) > 1e-4
    want = np.floor(facts.e) + (facts.lot < facts.e - np.floor(facts.e))
    assert all(after[d] == n for d, n in zip(facts.doc_id[clear], want[clear])) and set(after) <= set(before) and clear.mean() > 0.99


def test_mixture_meets_its_targets_and_rate(stages):
    """Expected shares of every margin within 1e-4 of their targets, and the tokens really drawn near the documented rate."""
    mixed = mixing.mix(stages[3], powers=pipeline.POWERS, rate=pipeline.RATE).toPandas()
    expected = mixed.tokens * mixed.expected
    for m in mixing.MARGINS:
        want = mixed.groupby(m).tokens.sum() ** pipeline.POWERS[m]
        assert np.allclose(expected.groupby(mixed[m]).sum() / expected.sum(), want / want.sum(), rtol=1e-4), m
    assert expected.sum() == pytest.approx(pipeline.RATE * mixed.tokens.sum())
    assert (mixed.tokens * mixed.copies).sum() > 0.9 * pipeline.RATE * mixed.tokens.sum()
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(dict(zip(mixed.doc_id, mixed.copies.astype(int)))) - Counter()


def test_packing(stages):
    t = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    kept, times = rows(stages[4]), Counter(r.doc_id for r in stages[4].collect())
    want = Counter({k: len(e.ids) + 1 for k, e in zip(kept, t.encode_batch([r.text for r in kept.values()], add_special_tokens=False))})
    got = Counter()
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == Counter({k: n * times[k] for k, n in want.items()})


def test_run_equals_the_stages_one_by_one(spark, small, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    docs = lambda f: sorted({(r.doc_id, r.doc_tokens) for r in f.collect()})  # noqa: E731  cuts depend on how the files are split
    assert docs(pipeline.run(spark, small)) == docs(stages[5]) and set(key) <= set(stages[5].columns)


def test_odd_and_empty_documents_pass_all_stages(spark, small, odd, no_docs):
    for frame in (odd, no_docs):
        for _, stage in pipeline.STAGES:
            frame = materialise(stage(spark, frame, small))
        assert frame.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
