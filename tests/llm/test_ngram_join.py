import random
import re

import numpy as np
import pytest

from gridloom.llm import graph
from gridloom.llm import ngram_join as nj
from gridloom.llm.graph import components


def sets_of(texts, words):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    return out


def roots_of(n, edges):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute(rows, words, percent):
    sets = sets_of([t for _, t in rows], words)
    owners = {}
    for k, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(k)
    common = {}
    for ks in owners.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    edges = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    roots = roots_of(len(rows), edges)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted((str(i), len(s), str(least[r])) for (i, _), s, r in zip(rows, sets, roots))


def got(frame, words, percent, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.join(frame, words=words, percent=percent, **options).collect())


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.5:
            w[k] = f"e{rng.randrange(10**6)}"
        elif kind < 0.75:
            w.insert(k, f"i{rng.randrange(10**6)}")
        elif len(w) > 1:
            del w[k]
    return w


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_links_and_components_equal_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = random.Random(words * percent)
    rows, line = [], [f"c{k}" for k in range(9)]
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 15, 40, 120, 300]))]
        for c in range(rng.choice([1, 2, 3, 12])):
            w = edited(rng, base, rng.choice([0, 1, 1, 2, len(base) // 30]))
            rows.append(" ".join(w + line if rng.random() < 0.4 else w))
    chain = [f"k{k}" for k in range(100)]  # each close to the next, the ends far apart
    for c in range(12):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    rng.shuffle(rows)
    rows = [(k, t) for k, t in enumerate(rows)] + [(5, "a"), (6, "a"), (7, ""), (8, None), (9, " \t"), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "solo here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as bucket", "2 as n").repartition(5)
    assert got(frame, words, percent) == brute(rows, words, percent)


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([1, 1, 2])))) for k in range(400)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85) == brute(rows, 4, 85)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(docs, 4, 85) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4, 85)


def test_parts_of_linked_sets_meet():
    rng, rule = np.random.default_rng(4), nj.Rule(4, 85)
    for size in [1, 2, 5, 6, 7, 8, 12, 30, 100, 400, 3000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for gone in range(0, len(a)):
                for more in {0, gone, max(0, (len(a) - gone) * 100 // 85 - len(a))}:
                    b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
                    both = len(np.intersect1d(a, b))
                    links = len(b) and 100 * both >= 85 * (len(a) + len(b) - both)
                    if links and (len(a) != both or len(b) != both):
                        (sa, la), (sb, lb) = nj.signatures(a, rule), nj.signatures(b, rule)
                        shared = np.intersect1d(sa, sb)
                        assert len(shared)
                        assert len(shared) >= min(la[np.isin(sa, shared)].min(), lb[np.isin(sb, shared)].min())
                if gone > 3 and not links:
                    break


def test_tree_returns_all_that_the_bound_allows():
    rng, rule = np.random.default_rng(2), nj.Rule(4, 52)
    base = rng.integers(0, 5, nj.GROUPS)
    points = np.maximum(0, base + rng.integers(-2, 3, (500, nj.GROUPS))).astype(np.uint16)
    sizes, owners = points.sum(1).astype(np.int64), rng.integers(0, 5, 500)
    tree = nj.Tree(points, sizes, owners, leaf=4)
    asked = np.arange(0, 500, 7)
    query, place, bound = tree.search(points[asked], sizes[asked], owners[asked], rule)
    got = sorted(zip(asked[query].tolist(), place.tolist(), bound.tolist()))
    want = []
    for k in asked:
        least = np.minimum(points, points[k]).sum(1).astype(int)
        hits = (owners != owners[k]) & (sizes >= sizes[k]) & (least >= rule.least_overlap(sizes[k], sizes))
        want += [(int(k), int(j), int(least[j])) for j in np.flatnonzero(hits)]
    assert got == want and len(want) > 100


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500 + k) for k in range(1, 50)]
    want = roots_of(600, edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    names = {}
    for r in rows:
        names.setdefault(r.root, set()).add(want[r.node])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({want[r.node] for r in rows})
    assert {r.node for r in rows} == {x for a, b in edges if a != b for x in (a, b)}


def test_components_go_on_with_more_edges(spark):
    rng = random.Random(3)
    rounds = [[(rng.randrange(300), rng.randrange(300)) for _ in range(n)] for n in (90, 60, 0, 40)] + [[(400 + k, 401 + k) for k in range(6)], [(0, 403), (7, 7)]]
    roots = components(spark.createDataFrame(rounds[0], "a long, b long"))
    for edges in rounds[1:]:
        roots = graph.extended(roots, spark.createDataFrame(edges, "a long, b long"))
    want = roots_of(500, sum(rounds, []))
    rows = roots.collect()
    names = {}
    for r in rows:
        names.setdefault(r.root, set()).add(want[r.node])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({want[r.node] for r in rows})
    assert sorted(r.node for r in rows) == sorted({x for edges in rounds for a, b in edges if a != b for x in (a, b)})


def test_links_are_worked_through_once(spark, monkeypatch):
    """After the first links, components get only links between the components that there are."""
    rows, frame = groups_of_near_copies(spark)
    monkeypatch.setattr(nj, "LEAF", 2)
    monkeypatch.setattr(nj, "FEW", 0)
    seen, plain = [], graph.components

    def counted(edges):
        seen.append(edges.where("a <> b").count())
        return plain(edges)

    monkeypatch.setattr(nj, "components", counted)
    monkeypatch.setattr(graph, "components", counted)
    assert got(frame, 5, 80) == brute(rows, 5, 80)
    assert len(seen) > 2 and seen[-1] < seen[0]


@pytest.mark.parametrize("times", [1, 2])
def test_sets_are_told_apart_only_where_identifiers_repeat(spark, monkeypatch, times):
    """Sets and points are not shuffled by node if each document is there once; rows that come twice give each node once."""
    rows, frame = groups_of_near_copies(spark)
    for _ in range(times - 1):
        rows, frame = rows + rows, frame.unionByName(frame)
    written, plain = [], nj.materialise

    def told(df, name="step"):
        out = plain(df, name)
        if name in ("sets", "points"):
            written.append("Deduplicate" in df._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(nj, "materialise", told)
    assert got(frame, 5, 80) == brute(rows, 5, 80)
    assert len(written) > 2 and any(written) == (times > 1)


def test_one_of_each_and_odd_tables(spark, odd, no_docs):
    assert nj.join(no_docs).count() == 0
    kept = nj.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 6)


def test_points_of_all_sizes_bound_the_overlap():
    """Points have more coordinates for larger sets; on the coarser of two the bound never falls below the overlap."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 40, 600, 700, 3000, 3300, 20_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**64, len(s) // 10 + 1, dtype=np.uint64)])) for s in sets]
    sets.append(np.arange(900, dtype=np.uint64))  # all in one group: a full point, which bounds nothing
    points = [nj.point(s) for s in sets]
    assert {len(p) for p in points} == {256, 512, 2048, 16_384} and (points[-1] == nj.FULL).all()
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    a, b = (pa.array([points[p[k]].tobytes() for p in pairs], pa.binary()) for k in (0, 1))
    bounds = nj._pair_bounds(a, b)
    for (i, j), bound in zip(pairs, bounds):
        assert bound >= len(np.intersect1d(sets[i], sets[j]))
    assert nj._points(pa.array([points[0].tobytes(), points[4].tobytes()], pa.binary())).shape == (2, 256)
    far = nj._pair_bounds(pa.array([points[4].tobytes()], pa.binary()), pa.array([points[5].tobytes()], pa.binary()))[0]
    assert far < nj.Rule(5, 80).least_overlap(3000, 3300)  # unlike large sets are told apart


def groups_of_near_copies(spark):
    """Groups of texts some of which link, over one shared passage in a part of them."""
    rng, rows = random.Random(21), []
    for g in range(30):
        base = [f"w{rng.randrange(90)}" for _ in range(rng.choice([8, 30, 60, 150]))]
        for c in range(rng.choice([3, 5, 24])):
            rows.append(" ".join(edited(rng, base, rng.choice([1, 2, max(1, len(base) // 12)]))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("leaf,few,rounds", [(nj.LEAF, nj.FEW, 1), (2, nj.FEW, 1), (2, 0, 2)])
def test_buckets_of_few_pairs_are_searched_once(spark, monkeypatch, leaf, few, rounds):
    """Leaves and buckets of few pairs give all pairs in the first round; only the others are searched again."""
    rows, frame = groups_of_near_copies(spark)
    monkeypatch.setattr(nj, "LEAF", leaf)
    monkeypatch.setattr(nj, "FEW", few)
    calls, search = [], nj.tree_pairs

    def counted(members, rule, nearest):
        calls.append(members.select("bucket").distinct().count())
        return search(members, rule, nearest)

    monkeypatch.setattr(nj, "tree_pairs", counted)
    assert got(frame, 5, 80) == brute(rows, 5, 80)
    assert len(calls) == 1 if rounds == 1 else len(calls) >= 2 and calls[1] < calls[0]


def test_leaf_pairs_are_all_that_the_bound_allows():
    """Buckets of up to a leaf, lying one after another, with points of different sizes."""
    import pyarrow as pa

    rng, rule = np.random.default_rng(8), nj.Rule(5, 60)
    sets, bucket = [], []
    for b, count in enumerate([3, 16, 1, 7, 16, 2]):
        base = np.unique(rng.integers(0, 2**64, 40 if b % 2 else 1100, dtype=np.uint64))
        for _ in range(count):
            sets.append(np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, len(base) // 2) :], rng.integers(0, 2**64, len(base) // 9, dtype=np.uint64)])))
            bucket.append(b)
    root, node = rng.integers(0, 3, len(sets)), rng.permutation(len(sets)).astype(np.int64)
    points = [nj.point(s).tobytes() for s in sets]
    leaf = pa.record_batch([pa.array(c) for c in (bucket, node, root, [len(s) for s in sets])] + [pa.array(points, pa.binary())], names=["bucket", "node", "root", "n", "point"])
    want = set()
    for i in range(len(sets)):
        for j in range(len(sets)):
            first = (len(sets[i]), node[i]) < (len(sets[j]), node[j])
            if bucket[i] == bucket[j] and root[i] != root[j] and first:
                if nj._pair_bounds(pa.array([points[i]]), pa.array([points[j]]))[0] >= rule.least_overlap(len(sets[i]), len(sets[j])):
                    want.add((int(node[i]), int(node[j])))
    a, b = nj.leaf_pairs(leaf, rule)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want) and len(want) > 20


def test_leaf_pairs_of_a_width_that_no_pair_fits():
    """Two large sets too unlike in size to link beside small ones that may: the width of the large ones' points has no pair left."""
    import pyarrow as pa

    rng, rule = np.random.default_rng(5), nj.Rule(5, 80)
    large = np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64))
    small = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64))
    for sets, bucket, want in [([large, large[:4200], small, small[:38]], [1, 1, 2, 2], [(3, 2)]), ([large, large[:4200]], [1, 1], []), ([], [], [])]:
        columns = [pa.array(c, pa.int64()) for c in (bucket, range(len(sets)), range(len(sets)), [len(s) for s in sets])]
        leaf = pa.record_batch([*columns, pa.array([nj.point(s).tobytes() for s in sets], pa.binary())], names=["bucket", "node", "root", "n", "point"])
        a, b = nj.leaf_pairs(leaf, rule)
        assert list(zip(a.tolist(), b.tolist())) == want
