import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing

RANKS, PATTERN = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [np.array(e.ids + [0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(docs, rows, reference, window=1024):
    got = packing.pack(docs, RANKS, PATTERN, window=window, with_ids=True).collect()
    truth = Counter((i, ids.tobytes()) for (i, _), ids in zip(rows, reference([t for _, t in rows])))
    parts, fill = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= window
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.sequence_id * window + r.offset - r.start, []).append(r)
    built = Counter()
    for pieces in parts.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
        assert [r.continued for r in pieces] == [k > 0 for k in range(len(pieces))]
        assert [r.continues for r in pieces] == [k < len(pieces) - 1 for k in range(len(pieces))]
        built[(pieces[0].doc_id, b"".join(r.ids for r in pieces))] += 1
    assert built == truth
    assert sorted(fill) == list(range(len(fill)))
    for s, spans in fill.items():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) == window or s == len(fill) - 1


def test_odd_texts_come_back_whole(odd, reference):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()], reference)


def test_small_windows(odd, reference):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()], reference, window=7)


def test_given_documents_have_the_ids_of_the_tokenizer(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], reference)


def test_mixed_characters(spark, reference):
    rng = np.random.default_rng(5)
    alphabet = list(" " * 30 + "\n\t'aAbszé1²½ßñ-_.,!\u00a0\u0085\u1680\u2003\u3000中😀\u0301\u200d\u00d7'")
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 300)))) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, reference)


def test_empty_table(no_docs):
    assert packing.pack(no_docs, RANKS, PATTERN).count() == 0


def test_memory_of_tokenising_is_bounded():
    """A batch of 8 MB is worked through in slices whose arrays take a part of what those of 4 MB take."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"word{k}" for k in range(500)], 1200)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
    assert batch.nbytes > 8_000_000
    encoder = packing.Encoder(RANKS, PATTERN)
    tracemalloc.start()
    counts = sum(pa.compute.sum(out.column(3)).as_py() for out in packing.token_rows(iter([batch]), encoder, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts > 1_200_000 and peak < 90_000_000


def as_columns(texts):
    blobs = [t.encode() for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])


@pytest.mark.parametrize("most", [0, 7, packing.KNOWN])
def test_pieces_of_earlier_batches_are_not_encoded_again(most, reference):
    texts = [" ".join(f"w{(k * k) % 23}é{k % 5}" for k in range(i, i + 60)) + (" " + "long" * 20) * 2 + " end" for i in range(4)]
    encoder = packing.Encoder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    encoder.known, asked, plain = packing.Pieces(most), [], encoder._plain
    encoder._plain = lambda data: (asked.append(len(data)), plain(data))[1]
    sizes = []
    for batch in (texts, texts, texts[::-1], ["other words " + texts[0]]):
        asked.clear()
        flat, counts = encoder.batch(*as_columns(batch))
        sizes.append(sum(asked))
        whole = [np.append(plain(t.encode()), packing.END) for t in batch]
        assert counts.tolist() == [len(w) for w in whole] and flat.tolist() == np.concatenate(whole).tolist()
    assert len(encoder.known.hashes) <= most and (sizes[1] < sizes[0] - 150 if most > 7 else sizes[1] <= sizes[0])


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    """Pieces of other bytes under a hash that is held are encoded for themselves."""
    encoder = packing.Encoder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    monkeypatch.setattr(packing.tb, "segment_hashes", lambda data, starts: np.arange(len(starts)).astype(np.uint64))
    for text in ("one two three four five", "six seven eight nine ten", "one two thrff four five", "a bb ccc dddd eeeee"):
        flat, _ = encoder.batch(*as_columns([text]))
        assert flat.tolist() == [*encoder._plain(text.encode()).tolist(), packing.END]
