"""Quality classifier by co-training.

Two views of a page are classified apart: its text content (hashed byte trigrams) and its metadata (language, source,
length and the layout figures of the page: letters, digits, signs, lines, repeated words and lines). Both logistic
models start from a small seed of labelled rows. Over the rounds each model labels all unlabelled documents of which it
is sure, and the other takes a damped Newton step on them together with the seed; the step's sums are made by the
cluster over every such document. The views are calibrated and weighted on labelled rows of their own, and a third part
of the labelled rows judges the rounds: of several step lengths the best counts there, and a round is undone, and the last,
if it loses more than the standard error of what it changes. Every document gets the combined probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.session import arrow_batches, materialise

GRAMS = 256  # buckets of the text view
LANGS, SOURCES = 8, 32  # hashed one-hot entries of the metadata view
FIGURES = 14
META = FIGURES + LANGS + SOURCES
JUDGES = 50  # labelled rows from which the standard error of a round's loss is trusted
ADDED = ("text_score", "metadata_score", "score", "kept")

_UPPER, _DIGIT, _SIGN, _OTHER = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
for _a, _b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _SIGN[_a:_b] = True
_OTHER[0x80:] = True


def _buckets(values: pa.Array, count: int) -> np.ndarray:
    data, offsets = tb.column(values.cast(pa.string()))
    out = np.zeros(len(values), np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = (tb.segment_hashes(data, offsets[:-1][some]) >> np.uint64(40)).astype(np.int64) % count
    return out


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the trigram buckets, less for short texts, as bytes."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, GRAMS))
    for i, j in tb.slices(offsets, tb.CHUNK):
        for low in range(int(offsets[i]), int(offsets[j]), tb.CHUNK):  # a text longer than a chunk is counted in parts
            part = data[low : min(low + tb.CHUNK + 2, int(offsets[j]))].astype(np.uint32)
            if len(part) < 3:
                continue
            gram = (part[:-2] * np.uint32(2654435761) + part[1:-1] * np.uint32(2246822519) + part[2:] * np.uint32(3266489917))
            gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(24)
            place = low + np.arange(len(gram))
            doc = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))[: len(gram)] if j - i > 1 else np.full(len(gram), i)
            inside = place + 3 <= offsets[doc + 1]
            counts[i:j] += np.bincount((doc[inside] - i) * GRAMS + gram[inside], minlength=(j - i) * GRAMS).reshape(j - i, GRAMS)
    total = counts.sum(1, keepdims=True)
    return np.rint(255 * np.sqrt(counts / np.maximum(total, 1)) * total / (total + 64)).astype(np.uint8)


def metadata_view(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> np.ndarray:
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((rows, META), np.float32)
    whole = np.maximum(size, 1)
    for i, j in tb.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        some = np.flatnonzero(np.diff(at))
        if not len(some):
            continue
        n = whole[i:j]
        share = lambda flags: np.add.reduceat(flags.astype(np.int64), at[:-1][some]) / n[some]
        for k, flags in enumerate((_UPPER, _DIGIT, _SIGN, _OTHER, tb.SPACE)):
            out[i + some, k] = share(flags[part])
        starts, ends, hashes = tb.words(part, at, lower=False)
        doc = np.searchsorted(at, starts, "right") - 1
        words = np.bincount(doc, minlength=j - i)
        first = np.unique(tb.mixed(hashes + doc.astype(np.uint64) * tb.BASE), return_index=True)[1]
        different = np.bincount(doc[first], minlength=j - i)
        length = np.bincount(doc, ends - starts, j - i) / np.maximum(words, 1)
        breaks = np.unique(np.concatenate([at[:-1][some], np.flatnonzero(part == 0x0A) + 1]))
        breaks = breaks[breaks < len(part)]
        line_doc = np.searchsorted(at, breaks, "right") - 1
        lines = np.maximum(np.bincount(line_doc, minlength=j - i), 1)
        line_hash = tb.segment_hashes(part, breaks, part == 0x0A)
        only = np.unique(tb.mixed(line_hash + line_doc.astype(np.uint64) * tb.BASE), return_index=True)[1]
        line_size = np.diff(breaks, append=len(part))
        longest = np.zeros(j - i)
        np.maximum.at(longest, line_doc, line_size)
        out[i:j, 5:FIGURES] = np.stack([
            np.log1p(size[i:j]), np.log1p(words), different / np.maximum(words, 1), length, np.log1p(lines), lines / n,
            np.bincount(line_doc[only], minlength=j - i) / lines, longest / n, words / n,
        ], 1)
    out[np.arange(rows), FIGURES + _buckets(lang, LANGS)] = 1
    out[np.arange(rows), FIGURES + LANGS + _buckets(source, SOURCES)] = 1
    return out


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _solved(x: np.ndarray, labels: np.ndarray, start: np.ndarray, ridge: float, centre: np.ndarray, steps: int) -> np.ndarray:
    """Weights of a logistic regression pulled towards ``centre``, by Newton steps that are halved until they gain."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - labels * z).mean() + 0.5 * ridge * ((w - centre) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(steps):
        p = _probability(x @ w)
        slope = x.T @ (p - labels) / len(labels) + ridge * (w - centre)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        for _ in range(20):
            if (then := loss(w - step)) < now:
                break
            step = step / 2
        else:
            break
        w, now = w - step, then
    return w


@dataclass
class View:
    """A logistic model on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    ridge: float = 1e-2

    @staticmethod
    def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 8) -> View:
        spread = rows.std(0)
        view = View(rows.mean(0), np.where(spread > 1e-6, spread, np.inf), np.zeros(rows.shape[1] + 1), ridge)
        view.weight = _solved(view.columns(rows), labels, view.weight, ridge, np.zeros_like(view.weight), steps)
        return view

    def columns(self, rows: np.ndarray) -> np.ndarray:
        return np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.columns(rows) @ self.weight

    def sums(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Slope and diagonal curvature of the loss, summed over the rows, and their number."""
        x = self.columns(rows)
        p = _probability(x @ self.weight)
        return np.stack([x.T @ (p - labels), (x * x).T @ (p * (1 - p)), np.full(x.shape[1], float(len(rows)))])

    def moved(self, own: np.ndarray, others: np.ndarray, trust: float, damping: float) -> View:
        slope, curve = self.ridge * self.weight, np.full(len(self.weight), self.ridge)
        for sums, share in ((own, 1.0), (others, trust)):
            if sums[2, 0]:
                slope, curve = slope + share * sums[0] / sums[2, 0], curve + share * sums[1] / sums[2, 0]
        return View(self.mean, self.scale, self.weight - damping * slope / curve, self.ridge)


@dataclass
class Round:
    """What a round did: pseudo-labels that each view got from the other, the loss on the judging rows, whether it was kept."""

    text_labels: int
    metadata_labels: int
    loss: float
    kept: bool


@dataclass
class Model:
    """Both views and how their calibrated scores are combined."""

    text: View | None = None
    metadata: View | None = None
    text_line: tuple[float, float] = (1.0, 0.0)  # calibration: slope and level of the log odds
    metadata_line: tuple[float, float] = (1.0, 0.0)
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)
    constant: float = 1.0
    history: list[Round] = field(default_factory=list)

    def logits(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.text(text), self.metadata(metadata)
        return self.text_line[0] * a + self.text_line[1], self.metadata_line[0] * b + self.metadata_line[1]

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return (np.full(len(text), self.constant),) * 3
        a, b = self.logits(text, metadata)
        return _probability(a), _probability(b), _probability(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _line(columns: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and level of a small logistic regression; slopes are pulled towards one over their number."""
    start = np.array([1.0 / columns.shape[1]] * columns.shape[1] + [0.0])
    return _solved(np.c_[columns, np.ones(len(columns))], labels, start, ridge, start, 25)


def _losses(labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return -(labels * np.log(p) + (1 - labels) * np.log(1 - p))


def _calibrated(text: View, metadata: View, rows, labels: np.ndarray) -> Model:
    a, b = text(rows[0]), metadata(rows[1])
    model = Model(text, metadata, tuple(_line(a[:, None], labels)), tuple(_line(b[:, None], labels)))
    model.mix = tuple(_line(np.c_[model.logits(*rows)], labels))
    return model


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_view, metadata_view`` of every row, as binary columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            a, b = text_view(data, offsets), metadata_view(data, offsets, batch.column(2), batch.column(3))
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())],
                                  names=["id", "text_view", "metadata_view"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), "lang", "source").mapInArrow(run, f"id {kind}, text_view binary, metadata_view binary")


def _matrix(values, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(-1, width)


def _parts(labels: np.ndarray, seed: int) -> list[np.ndarray]:
    """Rows to learn from, to calibrate on and to judge by: up to ``seed`` rows, but no more than half, and the rest dealt in
    turn. A part that would hold one class alone shares the rows of all."""
    place = np.arange(len(labels))
    learn = place < min(seed, -(-len(labels) // 2))
    parts = [learn, ~learn & (place % 2 == 0), ~learn & (place % 2 == 1)]
    return [p if len({*labels[p]}) == 2 else np.ones(len(labels), bool) for p in parts]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 12_000, seed: int = 4_000, rounds: int = 4, sure: float = 0.95, trust: float = 1.0, damping: float = 0.5,
) -> Model:
    """Train both views. ``labels``: identifier and 0 / 1.

    At most ``max_labelled`` labelled rows are used, those of the smallest identifier hashes: up to ``seed`` of them, half at
    most, to learn from, the others to calibrate and to judge rounds. Labels that contradict each other are averaged, null
    labels are left out. Pseudo-labels are given to all other documents. ``history`` tells what each round exchanged and
    whether it was kept. Without labels, or with labels of one class alone, the model is that class's share.
    """
    with arrow_batches(docs.sparkSession):
        return _fitted(docs, labels, id_col, text_col, label_col, max_labelled, seed, rounds, sure, trust, damping)


def _fitted(docs, labels, id_col, text_col, label_col, max_labelled, seed, rounds, sure, trust, damping) -> Model:
    ident = F.col(f"`{id_col}`")
    gold = labels.where(ident.isNotNull() & F.col(label_col).isNotNull()).groupBy(ident.alias("id")).agg(F.avg(label_col).alias("label"))
    gold = gold.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    gold = docs.sparkSession.createDataFrame([(r.id, float(r.label >= 0.5)) for r in gold.collect()], f"id {labels.schema[id_col].dataType.simpleString()}, label double")
    table = materialise(views(docs, id_col, text_col).join(F.broadcast(gold), "id", "left"), "views")
    known = table.where("label is not null").dropDuplicates(["id"]).withColumn("key", F.xxhash64("id")).limit(max_labelled).toPandas()
    y = known["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 1.0)
    known = known.sort_values(["key", "id"])
    y = known["label"].to_numpy()
    x = _matrix(known["text_view"], np.uint8, GRAMS).astype(float) / 255, _matrix(known["metadata_view"], np.float32, META).astype(float)
    learn, level, judge = _parts(y, seed)
    of = lambda part: (x[0][part], x[1][part])

    def judged(text: View, metadata: View) -> tuple[Model, np.ndarray]:
        model = _calibrated(text, metadata, of(level), y[level])
        return model, _losses(y[judge], model.scores(*of(judge))[2])

    best, least = judged(View.fit(x[0][learn], y[learn]), View.fit(x[1][learn], y[learn]))
    for _ in range(rounds):
        sums = _exchange(table, best, sure)
        own = best.text.sums(x[0][learn], y[learn]), best.metadata.sums(x[1][learn], y[learn])
        tried = [
            judged(best.text.moved(own[0], sums[0], trust, d), best.metadata.moved(own[1], sums[1], trust, d))
            for d in (damping / 4**k for k in range(3))
        ]
        model, after = min(tried, key=lambda t: t[1].mean())
        allowed = least.std() / np.sqrt(len(least)) if len(least) >= JUDGES else 0.0
        kept = bool(after.mean() <= least.mean() + allowed)
        model.history = [*best.history, Round(int(sums[0][2, 0]), int(sums[1][2, 0]), float(after.mean()), kept)]
        if not kept:
            best.history = model.history
            break
        best, least = model, min(least, after, key=np.mean)
    return best


def _exchange(table: DataFrame, model: Model, sure: float) -> list[np.ndarray]:
    """The loss sums of each view over all unlabelled documents of which the other view is sure."""
    edge = np.log(sure / (1 - sure))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, GRAMS + 1)), np.zeros((3, META + 1))]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                a = _matrix(part.column(0).to_pylist(), np.uint8, GRAMS) / 255.0
                b = _matrix(part.column(1).to_pylist(), np.float32, META).astype(float)
                by_text, by_metadata = model.logits(a, b)
                for k, (view, rows, judge) in enumerate(((model.text, a, by_metadata), (model.metadata, b, by_text))):
                    take = np.abs(judge) >= edge
                    if take.any():
                        total[k] += view.sums(rows[take], (judge[take] > 0).astype(float))
        which = np.concatenate([np.full(t.shape[1], k) for k, t in enumerate(total)])
        place = np.concatenate([np.arange(t.shape[1]) for t in total])
        yield pa.record_batch([pa.array(which), pa.array(place), *(pa.array(np.concatenate([t[r] for t in total])) for r in range(3))],
                              names=["view", "place", "slope", "curve", "rows"])

    unknown = table.where("label is null").select("text_view", "metadata_view")
    sums = unknown.mapInArrow(run, "view long, place long, slope double, curve double, rows double")
    out = [np.zeros((3, GRAMS + 1)), np.zeros((3, META + 1))]
    for r in sums.groupBy("view", "place").agg(*[F.sum(c).alias(c) for c in ("slope", "curve", "rows")]).collect():  # one row per weight
        out[r.view][:, r.place] = r.slope, r.curve, r["rows"]
    return out


def classify(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``text_score, metadata_score, score, kept``; columns of these names are replaced.

    A null text counts as empty and is judged like any other; every row is scored for itself.
    """
    fields = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(names.index(text_col)))
            a, b = text_view(data, offsets), metadata_view(data, offsets, batch.column(names.index("lang")), batch.column(names.index("source")))
            scores = model.scores(a / 255.0, b.astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores), pa.array(scores[2] >= least)], names=[*names, *ADDED])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, shape + ", text_score double, metadata_score double, score double, kept boolean")
