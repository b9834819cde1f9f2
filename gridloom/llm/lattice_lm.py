"""Language-model scores from a subword lattice.

A word is scored by the sum over all its segmentations into the pieces of an existing vocabulary. The vocabulary's
scores (ranks) give the first weights; expectation steps over the counted words of the training documents turn them
into trained piece probabilities. The sums are forward recursions in log space, for many words at once: edges
come from a trie walked in parallel from all positions, and states are filled in order of their distance from the
word's start. A document's probability is the product over its words and its end, since no piece crosses a word.

Words are counted and scored once over the whole corpus. Documents meet the scores in two ways: the most frequent
words (at most ``frequent`` by their share of all tokens, hence a bounded table) are sent to the tasks, all others
are joined by the word, none of which can then be frequent enough to swell a partition.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.session import materialise

MARK = "▁"  # stands for the space before a word
STOP = 0xFF  # no UTF-8 text has this byte
HELD_OUT = 10


class Lattice:
    """All segmentations of many words at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        self.bytes = np.zeros(256, np.int32)
        nodes, piece, rank = [{}], [-1], np.zeros(self.size)
        for k in range(self.size):
            if sp.is_byte(k):
                self.bytes[int(sp.id_to_piece(k)[3:5], 16)] = k
                rank[k] = self.size
                continue
            text = sp.id_to_piece(k)
            if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or not text or MARK in text[1:]:
                continue
            rank[k] = 1 - sp.get_score(k)
            at = 0
            for b in text.encode():
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({}), piece.append(-1)
                at = nodes[at][b]
            piece[at] = k
        # Nodes with children first, in breadth order: their rows form the transition table.
        order, depth = [0], 0
        while depth < len(order):
            order += nodes[order[depth]].values()
            depth += 1
        inner = [n for n in order if nodes[n]]
        number = {n: i for i, n in enumerate(inner + [n for n in order if not nodes[n]])}
        self.inner = len(inner)
        self.table = np.zeros((self.inner, 256), np.int32)
        for n in inner:
            for b, child in nodes[n].items():
                self.table[number[n], b] = number[child]
        self.piece = np.full(len(order), -1, np.int32)
        for n in order:
            self.piece[number[n]] = piece[n]
        used = rank > 0
        self.prior = np.where(used, 1.0 / np.maximum(rank, 1), 0.0)
        self.prior /= self.prior.sum()

    def weights(self, counts: np.ndarray | None = None, ends: int = 0, strength: float = 1000.0) -> tuple[np.ndarray, float]:
        """Log probabilities of the pieces and of the document's end: the prior alone, or with expected counts."""
        counts = np.zeros(self.size) if counts is None else counts
        mass = counts.sum() + strength + ends + 0.1
        with np.errstate(divide="ignore"):
            return np.log((counts + strength * self.prior) / mass), math.log((ends + 0.1) / mass)

    def layout(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The words one after another, each led by the mark and closed by the stop byte; their first states and last states."""
        mark = np.frombuffer(MARK.encode(), np.uint8)
        sizes = ends - starts + len(mark) + 1
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        out = np.full(int(sizes.sum()), STOP, np.uint8)
        for k, b in enumerate(mark):
            out[first + k] = b
        inside = np.repeat(first + len(mark) - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(int((ends - starts).sum()))
        out[inside] = tb.gathered(data, starts, ends - starts)
        return out, first, last

    def edges(self, text: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(from, to, piece) of all pieces and bytes that occur, sorted by the distance of ``to`` from the word's start."""
        at = np.flatnonzero(text != STOP)
        begin, end, kind = [at], [at + 1], [self.bytes[text[at]]]
        node, depth = np.zeros(len(at), np.int32), 0
        while len(at):
            node = self.table[node, text[at + depth]]
            depth += 1
            hit = self.piece[node] >= 0
            begin.append(at[hit]), end.append(at[hit] + depth), kind.append(self.piece[node[hit]])
            on = (node > 0) & (node < self.inner)
            at, node = at[on], node[on]
        begin, end, kind = np.concatenate(begin), np.concatenate(end), np.concatenate(kind)
        distance = np.arange(len(text)) - np.repeat(first, last - first + 1)
        order = np.argsort(distance[end] * len(text) + end, kind="stable")
        begin, end, kind = begin[order], end[order], kind[order]
        steps = distance[end]
        bounds = np.searchsorted(steps, np.arange(1, (int(steps[-1]) if len(steps) else 0) + 2))
        return begin, end, kind, bounds

    @staticmethod
    def forward(size: int, first: np.ndarray, edges, weight: np.ndarray) -> np.ndarray:
        """Log probability of reaching each state."""
        begin, end, kind, bounds = edges
        state = np.full(size, -np.inf)
        state[first] = 0.0
        gain = weight[kind]
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        groups = np.searchsorted(heads, bounds)
        for lo, hi, a, b in zip(bounds[:-1], bounds[1:], groups[:-1], groups[1:]):
            if hi > lo:
                state[end[heads[a:b]]] = np.logaddexp.reduceat(state[begin[lo:hi]] + gain[lo:hi], heads[a:b] - lo)
        return state

    def expected(self, state: np.ndarray, last: np.ndarray, edges, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, each word counted ``counts`` times."""
        begin, end, kind, bounds = edges
        flow = np.zeros(len(state))
        flow[last] = counts
        share = np.exp(state[begin] + weight[kind] - state[end])
        single = self.bytes_mask[kind]
        total = np.zeros(self.size)
        for lo, hi in zip(bounds[-2::-1], bounds[:0:-1]):
            if hi > lo:
                share[lo:hi] *= flow[end[lo:hi]]
                for part in (single[lo:hi], ~single[lo:hi]):  # a state has at most one edge of each sort to another
                    flow[begin[lo:hi][part]] += share[lo:hi][part]
        total += np.bincount(kind, share, self.size)
        return total

    @property
    def bytes_mask(self) -> np.ndarray:
        mask = np.zeros(self.size, bool)
        mask[self.bytes] = True
        return mask


def _word_slices(data: np.ndarray, offsets: np.ndarray):
    for i, j in tb.slices(offsets, tb.CHUNK // 4):
        yield i, j, data, offsets[i:j], offsets[i + 1 : j + 1]


def is_training(ids: list) -> np.ndarray:
    """Whether a document's identifier (as text; null as empty text) puts it among the training documents."""
    return np.array([zlib.crc32((x or "").encode()) % HELD_OUT != 0 for x in ids], bool)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table ``word, uses, train_uses`` of all words (A-Z lower-cased) of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            train = is_training(batch.column(0).to_pylist())
            for i, j in tb.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, hashes = tb.words(part, offsets[i : j + 1] - offsets[i])
                if not len(starts):
                    continue
                _, model, which = np.unique(hashes, return_index=True, return_inverse=True)
                if (ends - starts != (ends - starts)[model][which]).any():  # two words with one hash: count each use for itself
                    model = which = np.arange(len(starts))
                learns = train[i + np.searchsorted(offsets[i : j + 1] - offsets[i], starts, "right") - 1]
                words = tb.strings(tb.LOWER[part], starts[model], ends[model])
                yield pa.record_batch(
                    [words.cast(pa.string()), pa.array(np.bincount(which, minlength=len(model))),
                     pa.array(np.bincount(which, learns, len(model)).astype(np.int64))],
                    names=["word", "uses", "train_uses"],
                )

    ids = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = ids.mapInArrow(run, "word string, uses long, train_uses long")
    return materialise(found.groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("train_uses").alias("train_uses")), "words")


def expected_pieces(words: DataFrame, model_file: str, rounds: int = 2, ends: int = 0) -> np.ndarray | None:
    """Expected piece counts over all words of the training documents: one number per piece, None without a round."""
    counts = None
    for _ in range(rounds):
        weight_now = counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(model_file)
            weight, _ = lattice.weights(weight_now, ends)
            total = np.zeros(lattice.size)
            for batch in batches:
                uses = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                for i, j, data, a, b in _word_slices(*tb.column(batch.column(0))):
                    text, first, last = lattice.layout(data, a, b)
                    edges = lattice.edges(text, first, last)
                    state = lattice.forward(len(text), first, edges, weight)
                    total += lattice.expected(state, last, edges, weight, uses[i:j])
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["piece", "expected"])

        sums = words.where("train_uses > 0").select("word", "train_uses").mapInArrow(run, "piece long, expected double")
        counts = np.zeros(_vocabulary_size(model_file))
        for row in sums.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():  # at most one row per piece
            counts[row.piece] = row.expected
    return counts


def _vocabulary_size(model_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()


def word_scores(words: DataFrame, model_file: str, counts: np.ndarray, ends: int) -> DataFrame:
    """Written table ``word, uses, train_uses, score``: log10 of the word's marginal probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_file)
        weight, _ = lattice.weights(counts, ends)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, j, data, a, b in _word_slices(*tb.column(batch.column(0))):
                text, first, last = lattice.layout(data, a, b)
                scores[i:j] = lattice.forward(len(text), first, lattice.edges(text, first, last), weight)[last] / math.log(10)
            yield pa.record_batch([*batch.columns, pa.array(scores)], names=["word", "uses", "train_uses", "score"])

    return materialise(words.mapInArrow(run, "word string, uses long, train_uses long, score double"), "word-scores")


def score(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 50_000, rounds: int = 2
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Documents whose identifier's CRC-32 is divisible by ten are held out. The end of a document counts as a token.
    ``base_score`` is an additively smoothed unigram over words, ``score`` the lattice's log10 probability. A null text
    counts as empty (its end alone); rows that repeat an identifier are scored each for itself and count twice in
    training; a null identifier is held out; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ident = F.col(f"`{id_col}`")
    bucket = F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % HELD_OUT
    trained = docs.select((bucket != 0).cast("long").alias("t")).agg(F.sum("t")).first()[0] or 0
    words = count_words(docs, id_col, text_col)
    all_uses, train_uses, known = words.agg(F.sum("uses"), F.sum("train_uses"), F.sum((F.col("train_uses") > 0).cast("long"))).first()
    tokens, types = (train_uses or 0) + trained, (known or 0) + (trained > 0)
    counts = expected_pieces(words, model_file, rounds, trained)
    end_score = Lattice(model_file).weights(counts, trained)[1] / math.log(10)
    scored = word_scores(words, model_file, counts, trained)
    below = tokens + 0.1 * (types + 1)

    # At most ``frequent`` words can have this share of all uses.
    heavy = scored.where((F.col("uses") * F.lit(frequent) >= F.lit(all_uses or 1)) & (F.octet_length("word") <= 256)).collect()
    data, offsets = tb.column(pa.array([r.word for r in heavy], pa.string()))
    hashes = tb.segment_hashes(data, offsets[:-1])
    order = np.argsort(hashes)
    hashes, heavy_train = hashes[order], np.array([r.train_uses for r in heavy], np.int64)[order]
    heavy_score, heavy_size = np.array([r.score for r in heavy], float)[order], np.diff(offsets)[order]
    heavy_base = np.log10((heavy_train + 0.1) / below)
    end_base = math.log10((trained + 0.1) / below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = tb.column(batch.column(2))
            train = is_training(batch.column(1).to_pylist())
            for i, j in tb.slices(offsets):
                part, rows = data[offsets[i] : offsets[j]], j - i
                starts, ends, own = tb.words(part, offsets[i : j + 1] - offsets[i])
                doc = np.searchsorted(offsets[i : j + 1] - offsets[i], starts, "right") - 1
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    hit = (hashes[place] == own) & (heavy_size[place] == ends - starts)
                else:
                    place, hit = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                d, p = doc[hit], place[hit]
                rare = tb.strings(tb.LOWER[part], starts[~hit], ends[~hit])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=rows))]).astype(np.int32)
                yield pa.record_batch(
                    [
                        pa.array(row + np.arange(rows)), batch.column(0).slice(i, rows), pa.array(~train[i:j]),
                        pa.array(np.bincount(doc, minlength=rows) + 1),
                        pa.array(np.bincount(d, heavy_train[p] > 0, rows).astype(np.int64) + (trained > 0)),
                        pa.array(np.bincount(d, heavy_base[p], rows) + end_base), pa.array(np.bincount(d, heavy_score[p], rows) + end_score),
                        pa.ListArray.from_arrays(pa.array(bounds), rare.cast(pa.string())),
                    ],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row += rows

    shape = f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>"
    found = materialise(docs.select(ident, ident.cast("string").alias("_id"), F.col(f"`{text_col}`")).mapInArrow(run, shape), "lm-documents")
    rest = found.select("row_id", F.explode("rare").alias("word")).join(scored.select("word", "train_uses", F.col("score").alias("own")), "word")
    rest = rest.groupBy("row_id").agg(
        F.sum((F.col("train_uses") > 0).cast("long")).alias("r_known"),
        F.sum(F.log10((F.col("train_uses") + 0.1) / F.lit(below))).alias("r_base"), F.sum("own").alias("r_score"),
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return found.join(rest, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "r_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        add("base_score", "r_base"), add("score", "r_score"),
    )
