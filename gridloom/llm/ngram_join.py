"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its word shingles, hashed. Documents with one set are one node. Whether two sets can reach
the wanted similarity is bounded by their count vectors: shingles are hashed into groups, and the overlap is at most
the sum over the groups of the smaller count. These vectors are the points of R-trees, whose boxes bound whole
subtrees in the same way; what the bound leaves is verified on the sets.

Who meets whom: sets that are similar enough differ in a bounded number of shingles. Sizes are dealt to classes, and
in a class the hash range is cut into more parts than there can be differences, so any two sets that link have a
part in common, shingle by shingle; the hash of a part is a bucket. A part of one set that holds a passage shared by
very many documents holds other shingles as a rule, so such passages make no large buckets.

Large groups of near copies are linked without forming their pairs: first every member of a bucket is verified against
the bucket's first member, if the two share as many buckets as a link needs, and components are built. Only buckets of three or more that still hold several components
go to the R-trees. A bucket of one leaf, or of few pairs, returns all pairs of different components that pass the bound, and is settled. Of
the others, the trees twice return each member's nearest point of another component, which merges most of what is
close, and then all such pairs; pairs are verified and join the components. Every link between different sets is thus either verified or within a component. Large buckets are
indexed in blocks, and the members query each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.llm.graph import components, extended
from gridloom.session import arrow_batches, attach, fits_broadcast, materialise, scratch

GROUPS = 256  # coordinates of a small set's point; larger sets have more, so that about two shingles share one
COARSE = 64  # coordinates of the boxes: sums of neighbouring ones
FINEST = 1 << 16
FULL = 255  # the largest count that a coordinate holds
ROUNDS = 2  # rounds that look for the nearest point of another component only, where a bucket has many pairs
LEAF = 16  # points of a tree's leaf; a bucket of no more is a single leaf
FEW = 8  # pairs for each asking member up to which a bucket gives all of its pairs at once
BLOCK = 2048  # members of a bucket indexed together
_SHINGLE = tuple(np.uint64(2 * k + 1) for k in (0x4F1BBCDCBFA53E0A, 0x2545F4914F6CDD1C, 0x1B873593CC9E2D51, 0x38495AB5A1B2C3D4, 0x5851F42D4C957F2D))


class Rule:
    """Similarity ``percent`` of the union, and the classes and parts that follow from it."""

    def __init__(self, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent
        self.bounds = [1]

    def _up_to(self, size: int) -> None:
        while self.bounds[-1] <= size:
            low = self.bounds[-1]
            self.bounds.append(max(low, low * 10_000 // (self.percent * self.percent)) + 1)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def least_overlap(self, a, b):
        """Common shingles that sets of these sizes need: percent / (100 + percent) of both sizes, rounded up."""
        return -(-(a + b) * self.percent // (100 + self.percent))

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, parts, differences at most) in which a set of this size is filed: its own class, and the one below
        where it can be the larger partner. Classes in which only equal sets link are left out."""
        self._up_to(size)
        own = int(np.searchsorted(self.bounds, size, "right")) - 1
        out = []
        for c in (own, own - 1):
            if c < 0:
                continue
            top = self.bounds[c + 1] - 1
            if c != own and size > self.largest_partner(top):
                continue
            differ = (top + self.largest_partner(top)) * (100 - self.percent) // (100 + self.percent)
            if differ:
                out.append((c, differ + 1 + -(-(differ + 1) // 20), differ))
        return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than a shingle count as one, no words as none."""
    out = []
    for i, j in tb.slices(offsets):
        starts, _, own = tb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.searchsorted(starts, offsets[i + 1 : j + 1] - offsets[i], "left")
        if len(own) >= words:
            joined = np.zeros(len(own) - words + 1, np.uint64)
            for k in range(words):
                joined += own[k : len(own) - words + 1 + k] * _SHINGLE[k % len(_SHINGLE)] * tb.powers(words + 1)[k // len(_SHINGLE)]
            joined = tb.mixed(joined)
        low = 0
        for high in ends:
            n = high - low
            if n >= words:
                out.append(np.unique(joined[low : high - words + 1]))
            elif n:
                whole = np.array([n], np.uint64)
                for h in own[low:high]:
                    whole = tb.mixed(whole * tb.BASE + h)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
            low = high
    return out


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set: the first names the node, the second tells different sets with one name apart."""
    sums = np.array([tb.mixed(s).sum(), tb.mixed(s ^ tb.BASE).sum()], np.uint64) + np.array([len(s), 0], np.uint64) * tb.BASE
    a = tb.mixed(sums).view(np.int64)
    return int(a[0]), int(a[1])


def signatures(s: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a set, one per part with shingles, and for each how many buckets of its class a set that links
    must share with this one: the parts left untouched by the differences, less the empty ones. If all of those
    could be empty, the empty parts are buckets too."""
    out, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for c, parts, differ in rule.classes(len(s)):
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        heads = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
        salt = tb.mixed((part[heads] + np.uint64(1)) * tb.BASE + np.uint64(c))
        out.append(tb.mixed(np.add.reduceat(s, heads) + salt))
        least.append(np.full(len(heads), max(1, len(heads) - differ), np.int32))
        if len(heads) <= differ:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[heads])
            out.append(tb.mixed(tb.mixed((empty + np.uint64(1)) * tb.BASE + np.uint64(c))))
            least.append(np.ones(len(empty), np.int32))
    return np.concatenate(out) >> np.uint64(16), np.concatenate(least)


def point(s: np.ndarray) -> np.ndarray:
    """The counts of a set's hash groups, a byte each. The number of groups is a power of two of about half the set's size. A
    point with a larger count is full in every coordinate, which bounds nothing and so loses nothing."""
    bits = GROUPS.bit_length() - 1
    while 1 << bits < min(FINEST, len(s) // 2):
        bits += 1
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (counts if counts.max() <= FULL else np.full(len(counts), FULL)).astype(np.uint8)


def folded(points: np.ndarray, width: int) -> np.ndarray:
    """The points on fewer coordinates: sums of neighbouring ones."""
    if points.shape[1] == width:
        return points
    return np.minimum(points.reshape(len(points), width, -1).sum(2, dtype=np.int64), 65_535).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles that sets with these points can share, row by row."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


class Tree:
    """A packed R-tree over count vectors. Boxes need their upper corners alone, for the bound takes minima with them;
    they are kept on coarser coordinates, and the full ones decide at the leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, owners: np.ndarray, leaf: int = LEAF):
        coarse = self.coarse(points)
        order = np.lexsort((*coarse.T[:3], coarse[:, : COARSE // 2].sum(1), sizes))
        self.order, self.leaf = order, leaf
        self.points, self.sizes, self.owners = points[order], sizes[order], owners[order]
        top, least, owner, same = coarse[order], self.sizes, self.owners, np.ones(len(order), bool)
        self.levels = [(top, least, owner, same)]  # from the points up: upper corner, least size, the one owner below, if one
        while len(top) > 1:
            heads = np.arange(0, len(top), leaf)
            low, high = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
            same = (low == high) & np.logical_and.reduceat(same, heads)
            top, least, owner = np.maximum.reduceat(top, heads), np.minimum.reduceat(least, heads), low
            self.levels.append((top, least, owner, same))

    @staticmethod
    def coarse(points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), COARSE, -1).sum(2, dtype=np.int32)

    def search(self, points: np.ndarray, sizes: np.ndarray, owners: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, bound) of all points of other owners, and of no smaller sets, that can share enough shingles
        with a query. All queries go down the tree together."""
        coarse = self.coarse(points)
        query, at = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, owner, same = self.levels[depth]
            if depth < len(self.levels) - 1:
                query = np.repeat(query, self.leaf)
                at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                inside = at < len(top)
                query, at = query[inside], at[inside]
            keep = np.zeros(len(at), bool)
            for low in range(0, len(at), 8192):  # bounds the memory of a large frontier
                q, k = query[low : low + 8192], at[low : low + 8192]
                need = rule.least_overlap(sizes[q], np.maximum(least[k], sizes[q]))
                keep[low : low + 8192] = overlap_bound(coarse[q], top[k]) >= need
            keep &= ~(same[at] & (owner[at] == owners[query]))
            query, at = query[keep], at[keep]
        large = self.sizes[at] >= sizes[query]
        query, at = query[large], at[large]
        bound = np.zeros(len(at), np.int64)
        width = min(points.shape[1], self.points.shape[1])
        mine, theirs, step = folded(points, width), folded(self.points, width), max(1, (1 << 21) // width)
        for low in range(0, len(at), step):
            bound[low : low + step] = overlap_bound(mine[query[low : low + step]], theirs[at[low : low + step]])
        keep = bound >= rule.least_overlap(sizes[query], self.sizes[at])
        return query[keep], self.order[at[keep]], bound[keep]


def described(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Written table ``doc_id, n, node, check``; node and check are null for a document without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            found = []  # a slice's sets are gone before the next one's are made
            for i, j in tb.slices(offsets):
                found += [(len(s), *(node_of(s) if len(s) else (None, None))) for s in shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)]
            yield pa.record_batch([batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=["doc_id", "n", "node", "check"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, node long, check long"), "shingle-sets")


def buckets(docs: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """Written table ``bucket, first, node, least`` of all buckets with two nodes or more.

    A task files each of its sets once, so copies do not multiply; a bucket is read as a sorted run, never held. One
    bucket has at most one row per node, while a node has a row in each of its parts.
    """
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = tb.column(batch.column(0))
            for i, j in tb.slices(offsets):
                rows, nodes, least = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int32)]
                for s in shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words):
                    if len(s) and (node := node_of(s)[0]) not in seen:
                        seen.add(node)
                        for column, values in zip((rows, least), signatures(s, rule)):
                            column.append(values)
                        nodes.append(np.full(len(rows[-1]), node, np.int64))
                yield pa.record_batch(
                    [pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])), pa.array(np.concatenate(least))],
                    names=["bucket", "node", "least"],
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, first, before, told = None, 0, 0, True
        for batch in batches:
            b, n, least = (c.to_numpy() for c in batch.columns)
            if not len(b):
                continue
            if bucket is not None:  # go on with the run of the last batch
                b, n, least = np.concatenate([[bucket], b]), np.concatenate([[before], n]), np.concatenate([[0], least])
            lead = 0 if bucket is None else 1
            new = np.empty(len(b), bool)
            new[0], new[1:] = True, b[1:] != b[:-1]
            run_of = np.cumsum(new) - 1
            firsts = n[new].copy()
            if lead:
                firsts[0] = first
            head = firsts[run_of]
            fresh = np.ones(len(b), bool)
            fresh[1:] = new[1:] | (n[1:] != n[:-1])
            fresh[:lead] = False
            more = fresh & (n != head)  # nodes behind the first of their run
            shown = np.zeros(len(firsts), bool)
            shown[run_of[more]] = True
            if lead and told:
                shown[0] = False  # the first node of this run is out already
            lead_rows = np.flatnonzero(shown)
            starts = np.flatnonzero(new)
            yield pa.record_batch(
                [pa.array(np.concatenate([b[starts[lead_rows]], b[more]])), pa.array(np.concatenate([firsts[lead_rows], head[more]])),
                 pa.array(np.concatenate([firsts[lead_rows], n[more]])), pa.array(np.concatenate([np.zeros(len(lead_rows), np.int32), least[more]]).astype(np.int32))],
                names=["bucket", "first", "node", "least"],
            )
            last = run_of[-1]
            told = bool((more & (run_of == last)).any()) or (bool(lead) and last == 0 and told)
            bucket, first, before = b[-1], firsts[last], n[-1]

    filed = docs.select(text_col).mapInArrow(file, "bucket long, node long, least int")
    runs = filed.repartition("bucket").sortWithinPartitions("bucket", "node")
    return materialise(runs.mapInArrow(scan, "bucket long, first long, node long, least int"), "buckets")


def set_table(docs: DataFrame, wanted: DataFrame, rule: Rule, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Written table of the wanted nodes (``node, rep``: a document that has the set): ``node, n, point``, or the whole
    sets as ``node, shingles``. Only the texts of the named documents are read into shingles."""
    names, shape = (["node", "shingles"], "node long, shingles array<long>") if whole else (["node", "n", "point"], "node long, n long, point binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                sets = [s for s in shingles(*tb.column(batch.column(0).slice(i, 64)), rule.words) if len(s)]
                nodes = pa.array([node_of(s)[0] for s in sets], pa.int64())
                if whole:
                    columns = [nodes, _lists(sets)]
                else:
                    columns = [nodes, pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary())]
                yield pa.record_batch(columns, names=names)

    wanted = materialise(wanted, "wanted")
    reps = wanted.select(F.col("rep").alias("_rep"))
    reps = F.broadcast(reps) if fits_broadcast(reps, 2_000_000, 64_000_000) else reps
    some = docs.join(reps, docs[id_col].eqNullSafe(F.col("_rep")), "left_semi").select(text_col)
    made = attach(some.mapInArrow(run, shape), wanted.select("node"), "node", "left_semi", max_rows=2_000_000, max_bytes=64_000_000)
    made = materialise(made, "sets" if whole else "points")
    # Each node is there once, unless identifiers repeat: only then are the sets shuffled.
    return made if made.count() == wanted.count() else materialise(made.dropDuplicates(["node"]), "sets" if whole else "points")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _points(values: pa.Array) -> np.ndarray:
    """Points as rows, on as many coordinates as the coarsest of them has."""
    data, offsets = tb.column(values)
    size = np.diff(offsets)
    out = np.zeros((len(size), int(size.min(initial=FINEST)) if len(size) else GROUPS), np.uint16)
    widths = np.unique(size)
    if len(widths) == 1:
        return data.reshape(out.shape).astype(np.uint16)
    for width in widths:
        rows = np.flatnonzero(size == width)
        out[rows] = folded(data[offsets[rows][:, None] + np.arange(width)], out.shape[1])
    return out


def _pair_bounds(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Most shingles that the pairs can share, each on the coordinates of its coarser point."""
    sizes = [pc.binary_length(c).to_numpy() for c in (a, b)]
    width = np.minimum(*sizes)
    out = np.zeros(len(a), np.int64)
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        for rows in np.array_split(same, -(-len(same) * int(w) // (1 << 21)) or 1):
            x, y = (folded(_points(c.take(pa.array(rows))), int(w)) for c in (a, b))
            out[rows] = overlap_bound(x, y)
    return out


def leaf_pairs(leaf: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different components that can share enough shingles, of buckets that are one leaf each, lying one after
    another. Columns as in ``tree_pairs``; the smaller set comes first, of equal ones the lesser name."""
    bucket, node, root, n = (leaf.column(leaf.schema.get_field_index(c)).to_numpy() for c in ("bucket", "node", "root", "n"))
    point = leaf.column(leaf.schema.get_field_index("point"))
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(LEAF, len(bucket))):
        i = np.flatnonzero((bucket[step:] == bucket[:-step]) & (root[step:] != root[:-step]))
        j = i + step
        turned = (n[j] < n[i]) | ((n[j] == n[i]) & (node[j] < node[i]))
        firsts.append(np.where(turned, j, i))
        seconds.append(np.where(turned, i, j))
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    need = rule.least_overlap(n[i], n[j])
    width, keep = pc.binary_length(point).to_numpy(), np.zeros(len(i), bool)
    width, fits = np.minimum(width[i], width[j]), n[i] >= need
    for w in np.unique(width[fits]):  # of some widths no pair may fit by size
        pairs = np.flatnonzero((width == w) & fits)
        rows, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        points, at = folded(_points(point.take(pa.array(rows))), int(w)), at.reshape(2, -1)
        step = max(1, (1 << 21) // int(w))
        for low in range(0, len(pairs), step):
            some = slice(low, low + step)
            keep[pairs[some]] = overlap_bound(points[at[0, some]], points[at[1, some]]) >= need[pairs[some]]
    return node[i[keep]], node[j[keep]]


def verified(pairs: DataFrame, points: DataFrame, sets_of, rule: Rule) -> DataFrame:
    """Written table ``a, b`` of the pairs that link. Points are compared first; ``sets_of`` makes the sets of the nodes of
    the pairs that pass."""
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            keep = pa.array(_pair_bounds(batch.column(4), batch.column(5)) >= rule.least_overlap(na, nb))
            yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    point_of = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"point_{c}"))
    rows = pairs.join(point_of("a"), "a").join(point_of("b"), "b").select("a", "b", "n_a", "n_b", "point_a", "point_b")
    left = materialise(rows.mapInArrow(bounded, "a long, b long"), "bounded-pairs")
    sets = sets_of(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct())
    set_of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    full = left.join(set_of("a"), "a").join(set_of("b"), "b")
    shared, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    # Row by row on columns: two sets at a time are in memory, however large they are.
    return materialise(full.where(shared * (100 + rule.percent) >= sizes * rule.percent).select("a", "b"), "links")


def tree_pairs(members: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    """Pairs ``a, b`` of different components that the R-trees of their bucket leave: all of them, or, if ``nearest``, each member's
    nearest alone where a bucket has many. Such a bucket is told in a row of its own (``open``), for not all of its pairs are here.
    ``members``: bucket, count, node, n, point, root."""
    blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
    rows = members.select("bucket", "node", "root", "n", "point", (F.col("count") <= LEAF).alias("leaf"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    index = rows.where("block = own").select("bucket", "block", F.lit(0).alias("asks"), "node", "root", "n", "point", "leaf")
    # A bucket of one block asks with the rows that it indexes.
    asked = rows.where(F.col("own") != F.col("block")).select("bucket", "block", F.lit(1).alias("asks"), "node", "root", "n", "point", "leaf")
    sweep = index.unionByName(asked).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")

    def answers(bucket: int, tree: Tree, names: np.ndarray, node, root, n, points):
        query, place, bound = tree.search(points, n, root, rule)
        a, b = node[query], names[place]
        order = (tree.sizes_by_place[place] > n[query]) | (b > a)  # the smaller set asks, of equal ones the lesser name
        query, a, b, bound = query[order], a[order], b[order], bound[order]
        if many := nearest and len(query) > FEW * len(n):
            best = np.lexsort((b, -bound, query))
            first = best[np.flatnonzero(np.diff(query[best], prepend=-1))]
            a, b = a[first], b[first]
        return a, b, np.full(int(many), bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, names, own, lone = None, [], None, None, None, None
        for batch in batches:
            small = batch.column(7)
            leaf, batch = batch.filter(small), batch.filter(pc.invert(small))
            if leaf.num_rows:
                if lone is not None:
                    leaf = pa.concat_batches([lone, leaf])
                ends = np.flatnonzero(np.diff(leaf.column(0).to_numpy()))
                cut = int(ends[-1]) + 1 if len(ends) else 0  # the last bucket may go on in the next batch
                yield _pairs(*([c] for c in leaf_pairs(leaf.slice(0, cut), rule)), [])
                lone = leaf.slice(cut)
            if not batch.num_rows:
                continue
            bucket, block, asks, node, root, n = (batch.column(k).to_numpy() for k in range(6))
            found = [], [], []
            change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *change], [*change, batch.num_rows]):
                key = (bucket[low], block[low])
                if at != key:
                    if held and tree is None:
                        tree, names, own = _grown(held)
                        for out, column in zip(found, answers(at[0], tree, names, *own)):
                            out.append(column)
                    at, held, tree, own = key, [], None, None
                rows_ = (node[low:high], root[low:high], n[low:high], _points(batch.column(6).slice(low, high - low)))
                if not asks[low]:
                    held.append(rows_)
                    continue
                if tree is None:
                    tree, names, own = _grown(held)
                    for out, column in zip(found, answers(at[0], tree, names, *own)):
                        out.append(column)
                    held, own = [], None  # the tree has its own copy of the points
                for out, column in zip(found, answers(at[0], tree, names, *rows_)):
                    out.append(column)
            yield _pairs(*found)
        if held and tree is None:
            tree, names, own = _grown(held)
            yield _pairs(*([c] for c in answers(at[0], tree, names, *own)))
        if lone is not None:
            yield _pairs(*([c] for c in leaf_pairs(lone, rule)), [])

    return sweep.mapInArrow(run, "a long, b long, open long").distinct()


def _grown(held: list) -> tuple[Tree, np.ndarray, tuple]:
    width = min(h[3].shape[1] for h in held)
    held = [(*h[:3], folded(h[3], width)) for h in held]
    node, root, n, points = (np.concatenate(c) for c in zip(*held))
    tree = Tree(points, n, root)
    tree.sizes_by_place = n
    return tree, node, (node, root, n, points)


def _pairs(a: list[np.ndarray], b: list[np.ndarray], left: list[np.ndarray]) -> pa.RecordBatch:
    """The pairs, each once within the batch, and the buckets that have more of them."""
    none = [np.zeros(0, np.int64)]
    both = np.unique(np.stack([np.concatenate(none + a), np.concatenate(none + b)], 1), axis=0)
    left = np.unique(np.concatenate(none + left))
    blank = lambda k: pa.nulls(k, pa.int64())
    pairs = [pa.concat_arrays([pa.array(both[:, k].copy()), blank(len(left))]) for k in (0, 1)]
    return pa.record_batch([*pairs, pa.concat_arrays([blank(len(both)), pa.array(left)])], names=["a", "b", "open"])


def open_members(filed: DataFrame, roots: DataFrame, points: DataFrame) -> DataFrame | None:
    """Members of the buckets of three or more that still hold several components; one bucket of those with the same
    members. None if there is no such bucket."""
    owned = filed.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    found = owned.groupBy("bucket").agg(
        F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    ).where("count > 2 and low <> high")
    found = materialise(found.groupBy("count", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "count"), "open-buckets")
    if found.isEmpty():
        return None
    return owned.join(found, "bucket").join(points, "node")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the least identifier that links reach.

    Two documents link if their shingle sets share ``percent`` percent of their union. Documents without words (null,
    empty or white text) have no shingles and link with nothing. Equal sets are one node; rows that repeat an identifier
    are documents of their own; a null identifier is no candidate for the least one unless there is no other; an empty
    table gives an empty result.
    """
    with scratch() as block, arrow_batches(docs.sparkSession):
        slim, least = _classes(docs, Rule(words, percent), id_col, text_col)
        block.keep(slim, least)
    return slim.join(least, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _classes(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: the documents with their nodes, and ``node, component_id``."""
    slim = described(docs, rule, id_col, text_col)
    reps = materialise(slim.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
    if not reps.where("low <> high").isEmpty():
        raise RuntimeError("two shingle sets share a 64-bit name; change the constants of the shingle hash")
    filed = buckets(docs, rule, text_col)
    # A pair that shares fewer buckets than a link needs meets again, if it can link, in a bucket of three or more.
    near = filed.where("first <> node").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.min("least").alias("least"))
    near = materialise(near.where("shared >= least").select("a", "b", "shared"), "near")
    # Points are needed of those pairs, and of all members of buckets of three or more.
    crowded = filed.groupBy("bucket").agg(F.count("*").alias("count")).where("count > 2").select("bucket")
    named = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).unionByName(filed.join(crowded, "bucket").select("node")).distinct()
    points = set_table(docs, named.join(reps, "node").select("node", "rep"), rule, id_col, text_col, whole=False)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link; what it takes to find out is removed."""
        def sets_of(nodes: DataFrame) -> DataFrame:
            return set_table(docs, nodes.join(reps, "node").select("node", "rep"), rule, id_col, text_col, whole=True)

        with scratch() as block:
            out = verified(pairs, points, sets_of, rule)
            block.keep(out)
        return out

    # Each node's likeliest partner first, which joins most of a group of copies; then the pairs that are still apart.
    best = near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    roots = components(linked(best))
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = near.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    roots = extended(roots, linked(apart.select("a", "b").join(best, ["a", "b"], "left_anti")))

    # Buckets of few pairs give all of them at once. Of the others, nearest points next: they merge what is close, so that few
    # pairs are left for the last round, which takes all.
    for k in range(ROUNDS + 1):
        members = open_members(filed, roots, points)
        if members is None:
            break
        pairs = materialise(tree_pairs(members, rule, nearest=k < ROUNDS), "tree-pairs")
        roots = extended(roots, linked(pairs.where("a is not null").select("a", "b")))
        # All pairs of the other buckets are settled: each is verified, or was within a component.
        left = pairs.where("open is not null").select(F.col("open").alias("bucket")).distinct()
        if left.isEmpty():
            break
        filed = materialise(filed.join(left, "bucket", "left_semi"), "filed-again")

    least = reps.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = materialise(least, "rooted")
    return slim, materialise(least.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id"), "classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that link, over any number of links, with one of a lesser identifier.

    Rows with a null identifier stay, and so do rows that repeat an identifier which stays.
    """
    linked = join(docs, id_col, **options).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    linked = materialise(linked, "near-copies")
    linked = F.broadcast(linked) if fits_broadcast(linked, 2_000_000, 64_000_000) else linked
    return docs.join(linked, docs[id_col] == F.col("_gone"), "left_anti")
