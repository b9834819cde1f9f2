"""Packing by concatenate and cut.

Pass one tokenises each document where it is read and notes the tokens before it in its partition. The totals of
the partitions are turned into offsets by prefix sums over groups of partitions and within them. Pass two cuts each
document at the fixed window borders of the whole token stream: one record per piece. Tokens never move.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.session import arrow_batches, fits_broadcast, new_path

END = 0  # token behind each document
SLICE = 1 << 20  # bytes of text tokenised at once: their positions and hashes take some 50 times as much memory
BATCH = 2 << 20  # bytes of a batch between Spark and a worker
KNOWN = 1 << 18  # pieces that an encoder remembers, some 10 MB
KNOWN_BYTES = 48  # longer pieces are not remembered

_SAFE_NEXT = np.zeros(256, bool)
_SAFE_NEXT[0x21:0x7F] = True
_SAFE_NEXT[0xC3:0xE0] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


class Pieces:
    """Pieces of text that were encoded before, by hash: their bytes, which are compared, and their ids. When ``most`` are
    held, no more are taken in."""

    def __init__(self, most: int = KNOWN):
        self.most = most
        self.hashes = np.zeros(0, np.uint64)
        self.rank = np.zeros(0, np.int64)  # of the sorted hashes: which piece
        self.text, self.text_ends = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
        self.ids, self.id_ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self._join()

    def _join(self) -> None:
        for name in ("text", "text_ends", "ids", "id_ends"):
            setattr(self, name, [np.concatenate(getattr(self, name))])

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those that are not known or have only a hash in common with one that is."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.rank[at], -1)
        ends = self.text_ends[0]
        found[(found >= 0) & (ends[found + 1] - ends[found] != lengths)] = -1
        hit = np.flatnonzero(found >= 0)
        if len(hit):
            sizes = lengths[hit]
            off = tb.gathered(data, starts[hit], sizes) != tb.gathered(self.text[0], ends[found[hit]], sizes)
            if off.any():
                found[hit[np.unique(np.repeat(np.arange(len(hit)), sizes)[off])]] = -1
        return found

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        """Take in pieces whose hashes are not held yet, with their ids (``ids[begins:begins + counts]``)."""
        at = np.searchsorted(self.hashes, hashes)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != hashes[~new]
        take = np.flatnonzero(new & (lengths <= KNOWN_BYTES))[: self.most - len(self.hashes)]
        if not len(take):
            return
        number = len(self.hashes) + np.arange(len(take))
        self.text.append(tb.gathered(data, starts[take], lengths[take]))
        self.text_ends.append(self.text_ends[0][-1] + np.cumsum(lengths[take]))
        self.ids.append(tb.gathered(ids, begins[take], counts[take]))
        self.id_ends.append(self.id_ends[0][-1] + np.cumsum(counts[take]))
        self._join()
        order = np.argsort(hashes[take], kind="stable")
        where = np.searchsorted(self.hashes, hashes[take][order])
        self.hashes = np.insert(self.hashes, where, hashes[take][order])
        self.rank = np.insert(self.rank, where, number[order])


class Encoder:
    """Byte-level BPE of a batch of texts; each distinct piece of text is encoded once, those of earlier batches not again.

    A single space between two visible characters always starts a new piece for the tokenizer's pattern, so the
    pieces between such spaces can be encoded apart. The ranks file holds the vocabulary of the tokenizer file.
    """

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known = Pieces()
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.sizes[rank] = len(token)

    def _plain(self, data: bytes) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(data.decode("utf-8", "replace")), np.uint32)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row closed by the end token, and the number of ids of each row."""
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            inner = (data[1:-1] == 0x20) & _SAFE_NEXT[data[2:]] & ~head[1:-2] & ~head[2:-1]
            visible = (data[:-2] >= 0x21) & (data[:-2] <= 0x7E)
            visible[1:] |= _TAIL[data[1:-2]] & _LEAD[data[:-3]] & ~head[1:-3]
            cut[1:-1] = inner & visible
        cut[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(data))
        apart = head[starts] | head[starts + lengths]  # first and last pieces of a row have no safe border
        common = np.flatnonzero(~apart)
        counts, places = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        pool, used = [], 0
        if len(common):
            hashes = tb.segment_hashes(data, starts)[common]
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            model = common[first]
            same = lengths[model][which] == lengths[common]
            if same.all():
                same = tb.gathered(data, starts[common], lengths[common]) == tb.gathered(data, starts[model][which], lengths[common])
            if not same.all():  # two pieces with one hash: encode each for itself
                apart[common] = True
                common = common[:0]
            else:
                found = self.known.find(hashes[first], data, starts[model], lengths[model])
                fresh = np.flatnonzero(found < 0)
                own, sizes_of = starts[model][fresh], lengths[model][fresh]
                ids = self._plain(tb.gathered(data, own, sizes_of).tobytes()) if len(fresh) else np.zeros(0, np.uint32)
                stops = np.cumsum(self.sizes[ids])
                bounds = np.searchsorted(stops, np.cumsum(sizes_of), "left") + 1
                begins = np.concatenate([[0], bounds[:-1]]) if len(fresh) else bounds
                place, count = np.zeros((2, len(model)), np.int64)
                place[fresh], count[fresh] = begins, bounds - begins
                hit = np.flatnonzero(found >= 0)
                ends = self.known.id_ends[0]
                place[hit], count[hit] = len(ids) + ends[found[hit]], ends[found[hit] + 1] - ends[found[hit]]
                counts[common], places[common] = count[which], place[which]
                pool += [ids, self.known.ids[0]]
                used = len(ids) + len(self.known.ids[0])
                self.known.learn(hashes[first][fresh], data, own, sizes_of, ids, begins, bounds - begins)
        for k in np.flatnonzero(apart):
            ids = self._plain(data[starts[k] : starts[k] + lengths[k]].tobytes())
            counts[k], places[k] = len(ids), used
            pool.append(ids)
            used += len(ids)
        pool.append(np.array([END], np.uint32))
        # One end token per row, placed behind the row's last piece.
        behind = np.searchsorted(starts, offsets[1:], "left")
        counts, places = np.insert(counts, behind, 1), np.insert(places, behind, used)
        flat = np.concatenate(pool)[np.repeat(places - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = total[behind + np.arange(1, rows + 1)]
        return flat, np.diff(ends, prepend=0)


def token_rows(batches: Iterator[pa.RecordBatch], encoder: Encoder, part: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``tokenised`` of one partition's identifiers and texts."""
    before = 0
    for batch in batches:
        data, offsets = tb.column(batch.column(1))
        for i, j in tb.slices(offsets, SLICE):
            flat, counts = encoder.batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(flat) and int(flat.max()) > 0xFFFF:
                raise OverflowError("ids are kept in 16 bits; this vocabulary has larger ones")
            body = np.ascontiguousarray(flat.astype("<u2"))
            ends = np.cumsum(counts)
            at = np.concatenate([[0], ends * 2])
            blobs = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(body)])
            yield pa.record_batch(
                [pa.array(np.full(j - i, part)), pa.array(before + ends - counts), batch.column(0).slice(i, j - i), pa.array(counts), blobs.cast(pa.binary())],
                names=["part", "before", "doc_id", "doc_tokens", "ids"],
            )
            before += int(ends[-1])


def tokenised(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table ``part, before, doc_id, doc_tokens, ids``: ids as 16-bit values, tokens before in the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return token_rows(batches, Encoder(ranks, pattern), TaskContext.get().partitionId())

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"part long, before long, doc_id {kind}, doc_tokens long, ids binary")
    path = new_path(spark, "tokens")
    with arrow_batches(spark, size=BATCH):
        out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def partition_offsets(tokens: DataFrame, group: int = 1024) -> DataFrame:
    """``part, base``: tokens in the partitions before. One row per partition; sums by group first, then within it."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total")).withColumn("bunch", F.floor(F.col("part") / group))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bunches = totals.groupBy("bunch").agg(F.sum("total").alias("sum"))
    bunches = bunches.select("bunch", F.coalesce(F.sum("sum").over(earlier(Window.orderBy("bunch"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("total").over(earlier(Window.partitionBy("bunch").orderBy("part"))), F.lit(0))
    return totals.withColumn("inside", inside).join(bunches, "bunch").select("part", (F.col("ahead") + F.col("inside")).alias("base"))


def pieces(tokens: DataFrame, window: int = 1024, with_ids: bool = False) -> DataFrame:
    """Cut the stream: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and whether the document
    goes on before (``continued``) or behind (``continues``) the piece; ``ids`` (32-bit, little-endian) if asked for.

    All sequences but the last are full. The last is filled up to ``window`` unless its length is a power of two.
    """
    bases = partition_offsets(tokens)
    if fits_broadcast(bases):
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued", "continues"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(3))
            counts, at = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in tb.slices(offsets):
                size, first = counts[i:j], at[i:j]
                ids = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u2").astype("<u4")
                many = (first + size - 1) // window - first // window + 1
                doc = np.repeat(np.arange(j - i), many)
                seq = first[doc] // window + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                low, high = np.maximum(first[doc], seq * window), np.minimum((first + size)[doc], (seq + 1) * window)
                start = low - first[doc]
                origin = (np.cumsum(size) - size)[doc] + start
                raw = memoryview(ids.view(np.uint8))
                spans = [raw[4 * a : 4 * b] for a, b in zip(origin, origin + (high - low))]
                columns = [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(high - low),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(size[doc]), pa.array(seq), pa.array(low - seq * window),
                    pa.array(start > 0), pa.array(high < (first + size)[doc]),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(s) for s in spans], pa.binary()))
                yield pa.record_batch(columns, names=names + ["ids"] * with_ids)

    kind = tokens.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continued boolean, continues boolean"
    return placed.mapInArrow(run, shape + ", ids binary" * with_ids)


def pack(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut. A null text counts as empty and is its end token alone; rows that repeat an identifier are
    documents of their own; a null identifier stays null; an empty table gives an empty result."""
    return pieces(tokenised(docs, ranks, pattern, id_col, text_col), window, with_ids)
