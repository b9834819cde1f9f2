"""Removal of repeated byte strings by sorted suffixes.

A byte goes if it lies in a string of ``span`` bytes that also starts anywhere else. Sorting every suffix would move
each text many times over, so suffixes are sorted at anchors only. An anchor is the least hash among the 64-byte grams
of a ``span``-byte window (the first of equals): equal windows have the same anchor at the same place, so it is enough
to compare windows that share an anchor gram. Grams that occur once are dropped; most do.

The suffixes of the anchors of one gram are sorted in both directions by deep-shallow sorting: a multikey quicksort
(taking eight bytes as one character, all groups at once) to a shallow depth, then a blind trie for each group that
still has a common prefix. Neighbours' common prefixes then tell for every window start whether its left part and its
right part equal those of another window. Grams with very many anchors are not gathered in one task: their windows
are hashed (128 bits) and counted instead, which map-side combine makes small.

Copies of whole texts are settled by their digest, and only one of them takes part in the sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.session import fits_broadcast, materialise

GRAM = 64
SHALLOW = 96  # bytes sorted by the multikey quicksort
CROWD = 20_000  # anchors of one gram sorted in one task at most
BUNCH = 3 << 20  # bytes of contexts sorted together


def text_name(body) -> tuple[int, int]:
    """Two 64-bit halves of a text's digest: a name, and a check that tells different texts with one name apart."""
    d = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position, by doubling."""
    h, width = tb.BYTE[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(tb.powers(2 * GRAM)[width]) + tb.mixed(h[width:]) if len(h) > width else h[:0]
        width *= 2
    return tb.mixed(h)


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, first, last window start) of every anchor of one text, in order of its windows.

    A position whose windows fall into two parts of a very long text is listed once for each part.
    """
    out = [[], [], [], []]
    reach = span - GRAM + 1
    for low in range(0, max(0, len(data) - span + 1), 1 << 22):
        part = data[low : low + (1 << 22) + span - 1]
        h = gram_hashes(part)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(key) // reach)
        wide = np.full(blocks * reach, np.uint64(2**64 - 1))
        wide[: len(key)] = key
        wide = wide.reshape(blocks, reach)
        ahead = np.minimum.accumulate(wide, 1).ravel()
        behind = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
        windows = len(part) - span + 1
        at = (np.minimum(behind[:windows], ahead[reach - 1 : reach - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        for column, values in zip(out, (h[at[heads]].view(np.int64), at[heads] + low, heads + low, np.append(heads[1:], windows) - 1 + low)):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def settled(data: np.ndarray, span: int, found: tuple) -> tuple[tuple, list[tuple[int, int]]]:
    """Anchors without the inner windows of runs of a period below 64, and the runs' first and last window starts.

    In a run of period p and at least ``span + p`` bytes every window equals the one p bytes before or behind it, and one
    of the first p. Only these stay, for comparison with other places.
    """
    gram, pos, lo, hi = found
    step = np.diff(pos)
    links = np.flatnonzero((gram[1:] == gram[:-1]) & (step > 0) & (step < GRAM))
    if not len(links):
        return found, []
    heads = np.flatnonzero(np.append(True, (np.diff(links) > 1) | (np.diff(step[links]) != 0)))
    runs, cuts = [], []
    for i, j in zip(links[heads], links[np.append(heads[1:], len(links)) - 1] + 1):
        period, first, end = int(step[i]), int(pos[i]), int(pos[j]) + GRAM
        ahead = data[end : end + span + GRAM]
        differ = np.flatnonzero(ahead != data[end - period : end - period + len(ahead)])
        end += int(differ[0]) if len(differ) else len(ahead)
        if end - first < span + period or not np.array_equal(data[first : end - period], data[first + period : end]):
            continue
        runs.append((first, end - span))
        if cuts and first + period <= cuts[-1][1] + 1:
            cuts[-1] = (cuts[-1][0], max(cuts[-1][1], end - span))
        else:
            cuts.append((first + period, end - span))
    if not runs:
        return found, []
    low, high = np.array(cuts, np.int64).T
    starts = np.unique(np.concatenate([lo, low, high + 1]))
    starts = starts[starts <= hi[-1]]
    ends = np.append(starts[1:] - 1, hi[-1])
    cut = np.searchsorted(low, starts, "right") - 1
    keep = (cut < 0) | (starts > high[cut])
    source = (np.searchsorted(lo, starts, "right") - 1)[keep]
    return (gram[source], pos[source], starts[keep], ends[keep]), runs


class BlindTrie:
    """Orders strings of one length that share a prefix: inner nodes know only where their strings branch."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.width = len(strings[0])
        self.root = [0]  # a leaf: the numbers of equal strings
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        new, node = self.strings[k], self.root
        while isinstance(node, tuple):
            node = node[1].get(new[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        differ = int.from_bytes(new, "big") ^ int.from_bytes(other, "big")
        if not differ:
            node.append(k)
            return
        depth = self.width - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][new[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][new[depth]] = [k]
            return
        branch = (depth, {other[depth]: node, new[depth]: [k]})
        if above is None:
            self.root = branch
        else:
            above[1][new[above[0]]] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the common prefix of each with the one before (the first: 0)."""
        order, common, todo = [], [], [(self.root, 0)]
        while todo:
            node, shared = todo.pop()
            if isinstance(node, tuple):
                keys = sorted(node[1], reverse=True)
                todo += [(node[1][b], shared if b == keys[-1] else node[0]) for b in keys]
            else:
                order += node
                common += [shared] + [self.width] * (len(node) - 1)
        return order, common


def deep_shallow(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups (which come in ascending order) and common prefixes with the one before.

    A string is the ``width`` bytes from its start, filled up with zeros beyond its size. The first of a group has -1.
    """
    width = -(-width // 8) * 8
    wide = np.zeros((len(starts), width), np.uint8)
    take = np.minimum(sizes, width)
    row = np.repeat(np.arange(len(starts)), take)
    column = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
    wide[row, column] = tb.gathered(data, starts, take)
    words = wide.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    classes = groups[order].astype(np.int64)
    common = np.full(len(order), -2, np.int64)  # -2: not told apart yet
    common[np.flatnonzero(np.diff(classes, prepend=-1))] = -1
    for depth in range(min(SHALLOW, width) // 8):
        heads = common != -2
        alone = heads & np.append(heads[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        rows, part = order[open_], np.cumsum(heads)[open_]
        word = words[rows, depth]
        turn = np.lexsort((word, part))
        order[open_], word = rows[turn], word[turn]
        differ = word[1:] ^ word[:-1]
        split = np.flatnonzero((part[1:] == part[:-1]) & (differ != 0))
        same = 7 - (np.frexp(differ[split].astype(float))[1] - 1) // 8
        high = differ[split] >> np.uint64(56) > 0  # rounding can lift a value over a power of two
        same = np.where(high, 0, same)
        below = np.uint64(1) << (np.uint64(8) * (np.uint64(7) - np.clip(same, 0, 7).astype(np.uint64)))
        same = np.where((differ[split] < below) & ~high, same + 1, same)
        common[open_[split + 1]] = 8 * depth + same
    heads = np.flatnonzero(common != -2)
    ends = np.append(heads[1:], len(order))
    for low, high in zip(heads[ends - heads > 1], ends[ends - heads > 1]):
        rows = order[low:high]
        inner, shared = BlindTrie([r.tobytes() for r in wide[rows]]).ordered()
        order[low:high] = rows[inner]
        common[low + 1 : high] = shared[1:]
    return order, common


def repeated_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    """For each context (the bytes from window start ``lo`` to the end of window ``hi``) and distance of the window
    start before the anchor: whether another context of the group has an equal window at that distance."""
    n, anchor = len(pos), offsets[:-1] + pos - lo
    right, right_common = deep_shallow(data, anchor, offsets[1:] - anchor, group, span)
    back = data[::-1]
    left, left_common = deep_shallow(back, len(data) - anchor, pos - lo, group, span - GRAM)
    out = np.zeros((n, span - GRAM + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    near, far = pos - hi, pos - lo
    # Nothing to find where even the best left and right neighbours together are too short.
    best_r, best_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for best, order, common in ((best_r, right, right_common), (best_l, left, left_common)):
        best[order] = np.maximum(common, np.append(common[1:], -1))
    useful = best_r + best_l >= span
    for r in range(span - GRAM + 1):
        rows = np.flatnonzero(useful & (near <= r) & (r <= far))
        if len(rows) < 2:
            continue
        class_r[right] = np.cumsum(right_common < span - r)
        class_l[left] = np.cumsum(left_common < r)
        key = class_l[rows] * (n + 1) + class_r[rows]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[rows, r] = count[which] > 1
    return out


def _runs(flags: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last window start) of the runs in each row of flags; column r stands for the start pos - r."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    change = np.diff(edge, axis=1)
    row, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return row, pos[row] - (end - 1), pos[row] - begin


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table ``doc_id, n, name, check``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            names = [text_name(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64())],
                names=["doc_id", "n", "name", "check"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, name long, check long"), "texts")


ANCHOR = "gram long, name long, pos long, lo long, hi long"


def shared_anchors(docs: DataFrame, text_col: str, span: int) -> DataFrame:
    """Written table of the anchors whose gram occurs at two anchors or more; each text counts once.

    Rows with ``pos`` -1 are runs of a short period; their windows ``lo`` to ``hi`` are repeated in any case.
    """
    names = [c.split()[0] for c in ANCHOR.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = tb.column(batch.column(0))
            for i, j in tb.slices(offsets):
                found = [[np.zeros(0, np.int64)] for _ in names]
                for k in range(i, j):
                    body = data[offsets[k] : offsets[k + 1]]
                    if len(body) < span or (name := text_name(body)[0]) in seen:
                        continue
                    seen.add(name)
                    (gram, *places), runs = settled(body, span, anchors(body, span))
                    for column, values in zip(found, (gram, np.full(len(gram), name), *places)):
                        column.append(values)
                    if runs:
                        for column, values in zip(found, (np.full(len(runs), name), np.full(len(runs), name), np.full(len(runs), -1), *np.array(runs, np.int64).T)):
                            column.append(values)
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in found], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, False  # the last row so far, and whether its gram has occurred before
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            run = rows[2] < 0
            if run.any():
                yield pa.record_batch([pa.array(c[run]) for c in rows], names=names)
                rows = [c[~run] for c in rows]
            if held is not None:
                rows = [np.concatenate([[h], c]) for h, c in zip(held, rows)]
            if not len(rows[0]):
                continue
            fresh = np.ones(len(rows[0]), bool)  # a text read in two tasks gives the same rows twice
            fresh[1:] = np.any([c[1:] != c[:-1] for c in rows[:4]], 0)
            rows = [c[fresh] for c in rows]
            again = np.zeros(len(rows[0]), bool)
            again[1:] = rows[0][1:] == rows[0][:-1]
            again[0] = told
            keep = again.copy()
            keep[:-1] |= again[1:]
            keep[-1] = False
            yield pa.record_batch([pa.array(c[keep]) for c in rows], names=names)
            held, told = [c[-1] for c in rows], bool(again[-1])
        if held is not None and told:
            yield pa.record_batch([pa.array([h]) for h in held], names=names)

    sorted_ = docs.select(text_col).mapInArrow(find, ANCHOR).repartition("gram").sortWithinPartitions("gram", "name", "pos", "lo")
    return materialise(sorted_.mapInArrow(scan, ANCHOR), "anchors")


def _contexts(docs: DataFrame, listed: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """The bytes around each listed anchor. ``listed``: doc_id and its anchors, as (gram, name, pos, lo, hi)."""
    names = [c.split()[0] for c in ANCHOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(0))
            lists = batch.column(1)
            for k in range(batch.num_rows):
                body = data[offsets[k] : offsets[k + 1]]
                rows = lists[k].values
                columns = [rows.field(c).to_numpy() for c in names]
                mine = columns[1] == text_name(body)[0]
                columns = [c[mine] for c in columns]
                size = columns[4] + span - columns[3]
                ends = np.concatenate([[0], np.cumsum(size)])
                for i, j in tb.slices(ends):
                    part, bounds = [c[i:j] for c in columns], ends[i : j + 1] - ends[i]
                    around = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(tb.gathered(body, part[3], size[i:j])))])
                    yield pa.record_batch([*map(pa.array, part), around.cast(pa.binary())], names=[*names, "around"])

    some = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    ids = listed.select(F.col("doc_id").alias("_listed"))
    if fits_broadcast(ids, 2_000_000, 64_000_000):
        some = some.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_listed")), "left_semi")
    joined = some.join(listed, F.col("_id").eqNullSafe(F.col("doc_id"))).select("_text", "anchors")
    return joined.mapInArrow(run, ANCHOR + ", around binary")


REPEATS = "name long, first long, last long"


def _sorted_repeats(contexts: DataFrame, span: int) -> DataFrame:
    """Runs of repeated window starts of the texts, by sorting the anchors of each gram in one task."""
    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        gram, name, pos, lo, hi = (table.column(k).to_numpy() for k in range(5))
        fresh = np.ones(len(gram), bool)  # documents that repeat identifier and text
        fresh[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1]) | (lo[1:] != lo[:-1])
        data, offsets = tb.column(table.column(5).chunk(0) if table.num_rows else table.column(5))
        keep = np.flatnonzero(fresh)
        size = np.diff(offsets)[keep]
        data, offsets = tb.gathered(data, offsets[:-1][keep], size), np.concatenate([[0], np.cumsum(size)])
        group = np.cumsum(np.diff(gram[keep], prepend=gram[0] - 1) != 0)
        row, first, last = _runs(repeated_windows(data, offsets, group, pos[keep], lo[keep], hi[keep], span), pos[keep])
        return pa.record_batch([pa.array(name[keep][row]), pa.array(first), pa.array(last)], names=["name", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                gram = batch.column(0).to_numpy()
                room = sum(b.nbytes for b in held) < BUNCH
                if room and batch.nbytes > 2 * BUNCH:
                    cut = max(1, int(batch.num_rows * BUNCH / batch.nbytes))
                    held.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                    continue
                if room:
                    held.append(batch)
                    break
                last = held[-1].column(0)[-1].as_py()  # go on to the end of this gram, then settle
                cut = int(np.searchsorted(gram, last, "right"))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield settle(held)
                    held = []
                batch = batch.slice(cut)
        if held:
            yield settle(held)

    return contexts.repartition("gram").sortWithinPartitions("gram", "name", "lo").mapInArrow(run, REPEATS)


def _counted_repeats(contexts: DataFrame, span: int) -> DataFrame:
    """The same for grams with very many anchors, by 128-bit hashes of the windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, name, _, lo, _ = (batch.column(k).to_numpy() for k in range(5))
            for k in range(batch.num_rows):
                body = batch.column(5)[k].as_buffer()
                digests = b"".join(hashlib.blake2b(body[a : a + span], digest_size=16).digest() for a in range(len(body) - span + 1))
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.record_batch(
                    [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.full(len(halves), name[k])), pa.array(lo[k] + np.arange(len(halves)))],
                    names=["a", "b", "name", "first"],
                )

    windows = contexts.mapInArrow(run, "a long, b long, name long, first long")
    place = F.struct("name", "first")
    twice = windows.groupBy("a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("a", "b")
    return windows.join(twice, ["a", "b"]).select("name", "first", F.col("first").alias("last"))


def covered(ranges: list[int], size: int, span: int) -> list[tuple[int, int]]:
    """Maximal removed runs; ``ranges`` holds first and last starts of repeated windows in turn."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])):
        b += span
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, crowd: int = CROWD) -> DataFrame:
    """``doc_id, name, ranges`` of the documents that lose bytes: first and last starts of repeated windows in turn."""
    if span <= GRAM:
        raise ValueError(f"span must exceed {GRAM}")
    slim = named(docs, id_col, text_col)
    texts = materialise(slim.where(F.col("n") >= span).groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")), "text-names")
    if not texts.where("low <> high").isEmpty():
        raise RuntimeError("two texts share a 64-bit name; change the digest")
    found = shared_anchors(docs, text_col, span)
    periodic = found.where("pos < 0").select("name", F.col("lo").alias("first"), F.col("hi").alias("last"))
    found = found.where("pos >= 0")
    crowds = materialise(found.groupBy("gram").count().where(F.col("count") > crowd).select("gram"), "crowds")
    listed = found.join(texts.select("name", "rep"), "name").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("gram", "name", "pos", "lo", "hi")).alias("anchors"))
    contexts = _contexts(docs, materialise(listed, "listed"), id_col, text_col, span)
    crowded = not crowds.isEmpty()
    if crowded:
        contexts = materialise(contexts, "contexts")
        few = F.broadcast(crowds) if fits_broadcast(crowds) else crowds
        runs = _sorted_repeats(contexts.join(few, "gram", "left_anti"), span).unionByName(_counted_repeats(contexts.join(few, "gram", "left_semi"), span))
    else:
        runs = _sorted_repeats(contexts, span)
    whole = texts.where("copies > 1").select("name", F.lit(0).cast("long").alias("first"), (F.col("n") - span).alias("last"))
    lists = runs.unionByName(whole).unionByName(periodic).groupBy("name").agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("ranges"))
    lists = materialise(lists, "repeats")
    return slim.select("doc_id", "name").distinct().join(lists, "name")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, crowd: int = CROWD, with_text: bool = False,
           floor: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and the remaining bytes ``kept`` if asked for.

    With ``floor``, a length below ``span``, the same is done for strings of that length, of which nothing is removed:
    ``n_repeated`` bytes lie in one that starts anywhere else, and ``longest_repeat`` is the longest stretch of them. It
    tells of shared passages that are too short to be removed.

    A null text counts as empty. Texts shorter than ``span`` lose nothing. Rows that repeat identifier and text are copies
    of each other and both lose all; null identifiers are treated like any; an empty table gives an empty result.
    """
    found = repeats(docs, id_col, text_col, span, crowd).withColumn("short", F.lit(False))
    if floor is not None:
        found = found.unionByName(repeats(docs, id_col, text_col, floor, crowd).withColumn("short", F.lit(True)))
    listed = lambda short: F.flatten(F.transform(F.collect_list(F.when(F.col("short") == short, F.struct("name", "ranges"))), _flat))
    gone = materialise(found.groupBy(F.col("doc_id").alias("_gone_id")).agg(listed(False).alias("entries"), listed(True).alias("passages")), "removals")
    small = F.broadcast(gone) if fits_broadcast(gone, 1_000_000, 48_000_000) else gone
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text")).join(small, F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left")

    def cuts_of(flat, body, name: int, length: int) -> list[tuple[int, int]]:
        at, out = 0, []
        if flat.is_valid:
            flat = flat.values.to_numpy()
            while at < len(flat):  # name, number of values, values
                if flat[at] == name:
                    out = covered(flat[at + 2 : at + 2 + flat[at + 1]].tolist(), len(body), length)
                at += 2 + int(flat[at + 1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            lists = batch.column(2), batch.column(3)
            removed, spans, digests, bodies, shared, longest = [], [], [], [], [], []
            for k in range(batch.num_rows):
                body = data[offsets[k] : offsets[k + 1]]
                name = text_name(body)[0] if lists[0][k].is_valid else 0
                cuts, passages = cuts_of(lists[0][k], body, name, span), cuts_of(lists[1][k], body, name, floor)
                kept = body.tobytes()
                if cuts:
                    edges = [0, *(x for c in cuts for x in c), len(body)]
                    kept = b"".join(kept[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(len(body) - len(kept)), spans.append(len(cuts)), digests.append(hashlib.sha256(kept).hexdigest())
                shared.append(sum(b - a for a, b in passages)), longest.append(max((b - a for a, b in passages), default=0))
                bodies.append(kept if with_text else None)
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(bodies, pa.binary())] * with_text + [pa.array(c, pa.int64()) for c in (shared, longest)] * (floor is not None)
            yield pa.record_batch(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text + ", n_repeated long, longest_repeat long" * (floor is not None)
    names = [c.split()[0] for c in shape.split(", ")]
    return rows.select("doc_id", "_text", "entries", "passages").mapInArrow(run, shape)


def _flat(entry: Column) -> Column:
    return F.concat(F.array(entry["name"], F.size(entry["ranges"]).cast("long")), entry["ranges"])
