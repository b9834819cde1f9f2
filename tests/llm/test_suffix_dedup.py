import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import suffix_dedup as sd


def brute(rows, span):
    seen = Counter(b[k : k + span] for b in rows for k in range(len(b) - span + 1))
    out = []
    for b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, span, crowd=sd.CROWD, parts=4):
    frame = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as gram", "'x' as name", "2 as pos").repartition(parts)
    got = sd.remove(frame, span=span, crowd=crowd, with_text=True).collect()
    want = brute([(t or "").encode() for _, t in texts], span)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(texts, want)), key=key)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    return sum(w[1] for w in want)


def passages(rng, n, size, alphabet="abcdefgh éß"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(size // 2, size))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [sd.CROWD, 3])
@pytest.mark.parametrize("span", [100, 400])
def test_equals_brute_force(spark, span, crowd):
    rng = random.Random(span)
    shared = passages(rng, 12, 3 * span) + ["ab" * span, "z" * (2 * span)]
    texts = []
    for k in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) // 3))
            parts.append(p[a : len(p) - rng.randrange(max(1, len(p) // 3))] if rng.random() < 0.8 else p)
            parts += passages(rng, 1, rng.choice([5, 60, span]))
        texts.append((k, "".join(parts)))
    texts += [(200, texts[3][1]), (201, texts[3][1]), (7, "same id, another text " * 30), (8, None), (9, ""), (None, texts[5][1] + "!"), (None, "q" * span), (10, "q" * (span - 1)), (11, "\x00" * (span + 5)), (12, "\x00" * span + "x")]
    texts += [texts[4], texts[4]]
    assert check(spark, texts, span, crowd) > 1000


def test_repeats_within_one_text_and_a_common_passage(spark):
    rng = random.Random(11)
    block, line = passages(rng, 1, 900)[0], passages(rng, 1, 700)[0]
    texts = [(0, block + "x" + block), (1, block[:399] + "y"), (2, "none of it")] + [(10 + k, passages(rng, 1, 80)[0] + line + passages(rng, 1, 80)[0]) for k in range(60)]
    check(spark, texts, 400)
    check(spark, texts, 400, crowd=5, parts=7)


def test_long_runs_have_few_and_bounded_contexts(spark):
    n, rng = 3_000_000, random.Random(2)
    texts = [(0, "z" * n), (1, "y" + "-=" * 1000 + "z" * 400), (2, "z" * 399 + "y"), (3, "".join(rng.choice("abc") for _ in range(500)) + "0" * n), (4, "-=" * 199 + "-+")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in sd.remove(frame).collect()}
    assert got == {0: (n, 1), 1: (2400, 1), 2: (0, 0), 3: (n, 1), 4: (0, 0)}
    body = np.frombuffer(texts[3][1].encode(), np.uint8)
    kept, runs = sd.settled(body, 400, sd.anchors(body, 400))
    assert len(kept[0]) < 100 and runs[0][0] <= 600 and runs[-1][1] == len(body) - 400
    lines = np.frombuffer(("-" * 300 + "\n").encode() * 100, np.uint8)  # many contexts of one text come in slices
    name = sd.text_name(lines)[0]
    listed = spark.createDataFrame([(0, [(1, name, k, k, k) for k in range(20_000)])], "doc_id long, anchors array<struct<gram:long,name:long,pos:long,lo:long,hi:long>>")
    docs = spark.createDataFrame([(0, lines.tobytes().decode())], "doc_id long, text string")
    sizes = sd._contexts(docs, listed, "doc_id", "text", 400).selectExpr("around = encode(substring(repeat(concat(repeat('-', 300), '\n'), 100), int(lo) + 1, 400), 'utf-8') as fits").groupBy("fits").count().collect()
    assert [(r.fits, r["count"]) for r in sizes] == [(True, 20_000)]


@pytest.mark.parametrize("crowd", [sd.CROWD, 3])
def test_runs_of_short_periods_equal_brute_force(spark, crowd):
    rng = random.Random(5)
    units = ["a", "ab", "abc", "x" * 20 + "y", "".join(rng.choice("abcd") for _ in range(63)), "q" * 63 + "r"]
    texts = [(k, "".join((u := rng.choice(units)) * (rng.choice([60, 99, 101, 130, 180, 300, 900]) // len(u) + 1) + rng.choice(["", "!", "a", "--"]) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    assert check(spark, texts, 100, crowd) > 1000


def test_every_window_has_one_anchor_inside_it():
    data = np.frombuffer(("".join(passages(random.Random(3), 40, 3000))).encode(), np.uint8)
    _, pos, lo, hi = sd.anchors(data, 400)
    assert lo[0] == 0 and hi[-1] == len(data) - 400 and (lo[1:] == hi[:-1] + 1).all()
    assert (pos >= hi).all() and (pos - lo <= 400 - sd.GRAM).all()
    assert len(sd.anchors(data[:399], 400)[0]) == 0


def test_deep_shallow_order_and_common_prefixes():
    rng = random.Random(6)
    pool = ["".join(rng.choice("ab") for _ in range(200)) for _ in range(6)]
    strings, groups = [], []
    for k in range(400):
        s = rng.choice(pool)
        cut = rng.randrange(200)
        strings.append((s[:cut] + rng.choice(pool)[cut:]).encode()[: rng.choice([200, 200, 150, 3])])
        groups.append(rng.randrange(5))
    strings += [b"\xff\xff\xff\xff\xff\xff\xff\xff" * 25, b"\xff\xff\xff\xff\xff\xff\xff\xfe" * 25, b"\x80" + b"\xff" * 199, b"\x7f" + b"\xff" * 199]
    groups += [7, 7, 7, 7]
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    order, common = sd.deep_shallow(data, np.cumsum(sizes) - sizes, sizes, np.array(groups), 200)
    padded = [s.ljust(200, b"\0") for s in strings]
    assert [(groups[k], padded[k]) for k in order] == sorted((g, p) for g, p in zip(groups, padded))
    for a, b, c in zip(order, order[1:], common[1:]):
        if groups[a] != groups[b]:
            assert c == -1
        else:
            assert c == next((i for i in range(200) if padded[a][i] != padded[b][i]), 200)


def test_given_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows, 400, parts=6) > 10_000


def test_odd_and_empty_tables(spark, odd, no_docs):
    assert sd.remove(no_docs).count() == 0
    rows = odd.select("text").collect()
    assert sum(r.n_removed for r in sd.remove(odd).collect()) == sum(w[1] for w in brute([(r.text or "").encode() for r in rows], 400))


def test_shorter_passages_are_told_and_stay(spark):
    """With a floor, what brute force would remove at that length is counted, and nothing else changes."""
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh éß") for _ in range(300))
    texts = [shared + passages(rng, 1, 500)[0], passages(rng, 1, 200)[0] + shared, passages(rng, 1, 700)[0], None, "", shared]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in sd.remove(frame, span=400, floor=150).collect()}
    plain = {r.doc_id: r for r in sd.remove(frame, span=400).collect()}
    for k, (long, short) in enumerate(zip(brute(raw, 400), brute(raw, 150))):
        r = got[k]
        assert (r.n_removed, r.n_repeated) == (long[1], short[1]) and r.longest_repeat <= r.n_repeated
        assert tuple(r)[:5] == tuple(plain[k])
    assert got[0].longest_repeat >= 280 and got[2].n_repeated == 0 and got[3].longest_repeat == 0
