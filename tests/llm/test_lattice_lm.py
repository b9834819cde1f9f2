import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import sentencepiece

from gridloom.llm import lattice_lm as lm
from gridloom.llm import textbytes as tb

MODEL = vocabularies.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice(MODEL)


def pieces_of():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = [(bytes([int(sp.id_to_piece(k)[3:5], 16)]), k) for k in range(sp.get_piece_size()) if sp.is_byte(k)]
    return out + [
        (sp.id_to_piece(k).encode(), k) for k in range(sp.get_piece_size())
        if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or lm.MARK in sp.id_to_piece(k)[1:])
    ]


@pytest.fixture(scope="module")
def by_text():
    out = {}
    for b, k in pieces_of():
        out.setdefault(b, []).append(k)
    return out


def slow(word, by_text, p):
    """(probability, expected counts) by a plain table over all segmentations."""
    s = (lm.MARK + word).encode()
    forward, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
    spans = [(i, j, k) for i in range(len(s)) for j in range(i + 1, len(s) + 1) for k in by_text.get(s[i:j], ())]
    for i, j, k in sorted(spans, key=lambda x: x[1]):
        forward[j] += forward[i] * p[k]
    for i, j, k in sorted(spans, key=lambda x: -x[0]):
        back[i] += back[j] * p[k]
    uses = Counter()
    for i, j, k in spans:
        uses[k] += forward[i] * p[k] * back[j] / forward[-1]
    return forward[-1], uses


def test_marginals_and_expectations_equal_plain_tables(lattice, by_text):
    words = ["the", "a", "tion", "naïve", "日本語", "x" * 40, "\u0001", "thouing", "the"]
    weight, _ = lattice.weights()
    data, offsets = tb.column(pa.array(words))
    text, first, last = lattice.layout(data, offsets[:-1], offsets[1:])
    edges = lattice.edges(text, first, last)
    state = lattice.forward(len(text), first, edges, weight)
    counts = np.arange(1.0, len(words) + 1)
    total = lattice.expected(state, last, edges, weight, counts)
    want = np.zeros(lattice.size)
    for w, c, got in zip(words, counts, state[last]):
        p, uses = slow(w, by_text, np.exp(weight))
        assert math.isclose(got, math.log(p), rel_tol=1e-9)
        for k, n in uses.items():
            want[k] += c * n
    assert np.allclose(total, want, rtol=1e-8, atol=1e-12)


def brute(rows, by_text, lattice):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", lower(t))) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [w for i, w in docs if not held(i)]
    c = Counter(x for w in train for x in w)
    c["\n"] = len(train)
    n, v = sum(c.values()), sum(1 for x in c.values() if x)
    expected, cache = np.zeros(lattice.size), {}
    prior = np.exp(lattice.weights(None, len(train))[0])
    for w, k in c.items():
        if w != "\n":
            for piece, uses in slow(w, by_text, prior)[1].items():
                expected[piece] += k * uses
    weight, end = lattice.weights(expected, len(train))
    out = []
    for i, w in docs:
        for x in w:
            if x not in cache:
                cache[x] = math.log10(slow(x, by_text, np.exp(weight))[0])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "\n"])
        out.append((i, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, "\n"]), n, base, sum(cache[x] for x in w) + end / math.log(10)))
    return out


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_scores_equal_brute_force(spark, lattice, by_text, frequent):
    rng = random.Random(1)
    words = ["the", "of", "Tion", "ing", "ß", "naïve", "zzz"] + ["w" + str(k) for k in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(None, "the of"), (3, None), (3, ""), (4, "\t x\n"), (4, "\t x\n"), (99, "y" * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as word", "2 as uses").repartition(3)
    got = [tuple(r) for r in lm.score(frame, MODEL, frequent=frequent, rounds=1).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(brute(rows, by_text, lattice), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_empty_table_and_odd_texts(no_docs, odd):
    assert lm.score(no_docs, MODEL).count() == 0
    assert lm.score(odd, MODEL).where("score is null or score >= 0 or isnan(score)").count() == 0


def test_training_helps_on_held_out_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    total = [lm.score(docs, MODEL, rounds=r).where("held_out").agg({"score": "sum"}).first()[0] for r in (0, 1, 2)]
    assert total[0] < total[1] < total[2]
