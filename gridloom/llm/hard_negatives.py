"""Hard negatives by a secondary sort.

Scores of anchors against rows are packed into keys (anchor, descending score, identifier). The shuffle deals them by
anchor and sorts them within partitions, so an iterator sees each anchor's rows from the best on. It opens a window for
each positive that it meets and hands out the negatives that fall into open windows; nothing of an anchor is held but
its few windows.

What is shuffled is first thinned where it is made, without losing a result. Rows are dealt to blocks of bounded size,
and the anchors go to every block. The first pass keeps an anchor's best positives of each block, which settles the
positives and so the windows. The second scores again and keeps, for each window, a block's first negatives: those
that come first overall are among them. So an anchor sends a few rows per block, however many rows it is compared with.

Scores are inner products of integer components and exact: they are computed in doubles where no sum can leave the range
in which doubles count one by one, otherwise in Python's integers; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise

BLOCK = 20_000  # rows of a block
BATCH = 256  # anchors scored at once against a block
EXACT = 2**53  # below it, doubles hold every integer


class Rule:
    """How many positives and negatives, and the window in hundredths of the positive's score."""

    def __init__(self, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90):
        if positives < 1 or negatives < 1 or low > high:
            raise ValueError("positives and negatives must be 1 or more, low no greater than high")
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high

    def window(self, score: int) -> tuple[int, int]:
        """Least and greatest score of a negative to a positive of this score."""
        return -(-self.low * score // 100), self.high * score // 100


def integers(vector: Column, scale: int = 256) -> Column:
    """Every component as ``floor(scale * x)``, x as a double; null where the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """Written table ``row, id, label, vector, anchor`` of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(f"`{vector_col}`")).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones go on with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (a, b)]
    if most[0] * most[1] * width < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if max(abs(exact.min(initial=0)), abs(exact.max(initial=0))) >= 2**63:
        raise OverflowError("a score leaves 64 bits")
    return exact.astype(np.int64)


def _ahead(scores: np.ndarray, taken: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best scores among the ``taken`` places, which are in order of identifier: ties keep it."""
    s = scores[taken]
    if len(taken) > 4 * most:
        least = np.partition(s, len(s) - most)[len(s) - most]
        above, level = taken[s > least], taken[s == least]
        taken = np.concatenate([above, level[: most - len(above)]])
        taken = np.sort(taken)
        s = scores[taken]
    return taken[np.argsort(-s, kind="stable")[:most]]


def _blocks(rows: DataFrame, asked: DataFrame, shape: str, answer) -> DataFrame:
    """``answer(block, anchors)`` for the rows of every block and all anchors, a batch of these at a time.

    ``asked``: ``row, id, label, vector, windows`` of the anchors. Rows are dealt to blocks by their row number, not by
    any column, so blocks are even whatever repeats.
    """
    spark = rows.sparkSession
    count = max(1, -(-rows.count() // BLOCK), min(64, spark.sparkContext.defaultParallelism))
    none = F.lit(None).cast(asked.schema["windows"].dataType)
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("block"), F.lit(0).alias("asks"), "row", "id", "label", "vector", none.alias("windows"))
    asking = asked.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.lit(1).alias("asks"), "row", "id", "label", "vector", "windows")
    both = dealt.unionByName(asking).repartition(count, "block").sortWithinPartitions("block", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key, asks = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(key)]):
                if low == high:
                    continue
                if at != key[low]:
                    at, held, block = key[low], [], None
                part = batch.slice(low, high - low)
                if not asks[low]:
                    held.append(part)
                    continue
                if block is None:
                    block = _columns(held) if held else False
                if block:
                    for i in range(0, part.num_rows, BATCH):
                        anchors = part.slice(i, BATCH)
                        yield from answer(block, _columns([anchors]), anchors.column(6))

    return both.mapInArrow(run, shape)


def _columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    return (*(table.column(k).to_numpy() for k in (2, 3, 4)), _matrix(table.column(5).combine_chunks()))


def positives(rows: DataFrame, rule: Rule) -> DataFrame:
    """Written table ``row, id, label, vector, windows``: the anchors with the (score, id) of their positives, best first."""
    def answer(block, anchors, _):
        names, ids, labels, vectors = block
        out = []
        scores = _scores(anchors[3], vectors)
        by_label = {v: np.flatnonzero(labels == v) for v in np.unique(anchors[2])}
        for k, (own, label) in enumerate(zip(anchors[0], anchors[2])):
            same = by_label[label]
            best = _ahead(scores[k], same[names[same] != own], rule.positives)
            out.append((np.full(len(best), own), scores[k][best], ids[best]))
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "score", "id"])

    anchors = rows.where("anchor")
    none = F.lit(None).cast("array<struct<score:long,id:long>>")
    found = _blocks(rows, anchors.withColumn("windows", none), "row long, score long, id long", answer)
    found = found.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, rule.positives).alias("best"))
    found = found.select("row", F.transform("best", lambda p: F.struct((-p["less"]).alias("score"), p["id"].alias("id"))).alias("windows"))
    return materialise(anchors.join(found, "row").select("row", "id", "label", "vector", "windows"), "anchors")


def negatives(rows: DataFrame, anchors: DataFrame, rule: Rule) -> DataFrame:
    """``row, score, id`` of the negatives that come first in a window of their anchor within their block."""
    def answer(block, asked, windows):
        _, ids, labels, vectors = block
        out = [(np.zeros(0, np.int64),) * 3]
        scores = _scores(asked[3], vectors)
        for k, own in enumerate(asked[0]):
            other = np.flatnonzero(labels != asked[2][k])
            s = scores[k][other]
            kept = [np.zeros(0, np.int64)]
            for positive in sorted({w["score"] for w in windows[k].as_py()}):
                low, high = rule.window(positive)
                if low <= high:
                    kept.append(_ahead(scores[k], other[(s >= low) & (s <= high)], rule.negatives))
            best = np.unique(np.concatenate(kept))
            out.append((np.full(len(best), own), scores[k][best], ids[best]))
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "score", "id"])

    return _blocks(rows, anchors, "row long, score long, id long", answer)


# The packed key: anchor's row, score from the greatest on, positives ahead of negatives of the same score, identifier.
# Signed numbers are shifted, so that bytes sort as they do.
KEY = ">QQBQ"
SHIFT = 1 << 63


def packed(row: int, score: int, negative: int, ident: int) -> bytes:
    return struct.pack(KEY, row + SHIFT, SHIFT - 1 - score, negative, ident + SHIFT)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    row, score, negative, ident = struct.unpack(KEY, key)
    return row - SHIFT, SHIFT - 1 - score, negative, ident - SHIFT


def _shard(key: bytes, shards: int) -> int:
    """The partition of an anchor, whatever else the key holds."""
    return (struct.unpack(KEY, key)[0] * 0x9E3779B97F4A7C15 % 2**64 >> 20) % shards


def streamed(pairs: Iterator[tuple[bytes, int]], rule: Rule) -> Iterator[tuple[int, int, int, int, int, int]]:
    """One pass over sorted keys: a positive opens a window, a negative goes to every window that it falls into and that is
    not full. Yields (anchor, positive, rank, negative, positive's score, negative's score)."""
    at, windows = None, []
    for key, anchor in pairs:
        row, score, negative, ident = unpacked(key)
        if row != at:
            at, windows = row, []
        if not negative:
            windows.append([*rule.window(score), 0, ident, score])
            continue
        for w in windows:
            if w[0] <= score <= w[1] and w[2] < rule.negatives:
                w[2] += 1
                yield anchor, w[3], w[2], ident, w[4], score


def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchor: Column | None = None,
    rule: Rule | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    ``label`` is the class of a row (default: column ``label``), ``anchor`` says which rows ask (default: all). An anchor's
    positives are its first other rows of the same label by descending score and ascending identifier; negatives are rows
    of other labels within the window of the positive's score. A positive with a negative score has an empty window.

    Rows with a null identifier, label, vector or component, or one that is not finite, take no part. Rows that repeat an
    identifier are rows of their own, as anchors too. Vectors of different lengths are compared as if the shorter one
    went on with zeros; an empty vector scores zero. An empty table, or one without anchors, gives an empty result.
    """
    rule = rule or Rule()
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, F.col("label") if label is None else label, F.lit(True) if anchor is None else anchor)
    asked = positives(rows, rule)
    found = negatives(rows, asked, rule)
    names = asked.select("row", F.col("id").alias("anchor_id"))
    opened = asked.select("row", F.col("id").alias("anchor_id"), F.explode("windows").alias("w"))
    opened = opened.select("row", "anchor_id", F.col("w.score").alias("score"), F.lit(0).alias("negative"), F.col("w.id").alias("id"))
    closed = found.join(names, "row").select("row", "anchor_id", "score", F.lit(1).alias("negative"), "id")
    pairs = materialise(opened.unionByName(closed), "pairs")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pairs.rdd.map(lambda r: (packed(r[0], r[2], r[3], r[4]), r[1]))
    in_order = keyed.repartitionAndSortWithinPartitions(shards, partial(_shard, shards=shards))
    out = in_order.mapPartitions(partial(streamed, rule=rule))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
