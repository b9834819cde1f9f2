"""Merkle manifest: SQL, a plain loop over odd rows, several arities, proofs and tampering."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes, arity):
    """The levels above ``nodes``, plainly."""
    steps = [nodes]
    while len(steps[-1]) > 1:
        steps.append([h(*steps[-1][i : i + arity]) for i in range(0, len(steps[-1]), arity)])
    return steps


def climbed(steps, at, arity):
    """(left, right) per level of the node at a place."""
    out = []
    for level in steps[:-1]:
        low = at // arity * arity
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + arity])))
        at //= arity
    return out


def expected(rows, arity=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root) of every row."""
    trees = {}
    for r in rows:
        trees.setdefault(r.source, []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs, placed = [], []
    for t, name in enumerate(names):
        mine = sorted(trees[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        steps = grown([leaf(r, r.text) for r in mine], arity)
        subs.append(steps[-1][0])
        placed += [(r, t, steps[0][i], climbed(steps, i, arity)) for i, r in enumerate(mine)]
    top = grown(subs, arity)
    out = []
    for r, t, own, path in placed:
        path = path + climbed(top, t, arity)
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
        fold = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if tampered else own
        for left, right in path:
            fold = h(left, fold, right)
        out.append((r.doc_id, own, subs[t], top[-1][0], h(*[a + b for a, b in path]), fold))
    return sorted(out, key=str)


def test_sql(compare, small):
    assert compare("op11_merkle_manifest", small) == ""


def test_odd_rows(odd):
    got = merkle.check_rows(odd).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got], key=str) == expected(odd.collect())
    assert all(r.verified == (r.folded_root == r.root) for r in got)


@pytest.mark.parametrize("arity, rows", [(2, 1), (2, 17), (3, 300), (16, 300)])
def test_sizes_and_arities(spark, arity, rows):
    """One source holds two thirds; another has a single leaf; last runs are short, some hold one node."""
    docs = spark.range(rows).selectExpr("id as doc_id", "case when id = 0 then null when id % 3 < 2 then 'hot' else 'Ä' end as source", "'en' as lang", "id as n_chars", "concat('T', id) as text")
    path = F.col("path")
    made = merkle.manifest(docs.repartition(5), COLUMNS, "source", ["doc_id"], arity)
    got = made.proofs(proof=F.sha2(merkle.proof(path), 256), fold=merkle.folded(F.col("digest"), path)).collect()
    want = [w[:5] for w in expected(docs.collect(), arity)]
    assert sorted([(r.row.doc_id, r.digest, r.subroot, r.root, r.proof) for r in got], key=str) == want
    assert all(r.fold == r.root == made.root for r in got)


def test_repeated_rows_are_leaves(spark):
    docs = spark.range(90).selectExpr("if(id < 60, 7L, id) as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "if(id < 60, 'copy', 'x') as text")
    got = merkle.check_rows(docs).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got], key=str) == expected(docs.collect())


def test_a_null_differs_from_empty_and_from_a_dash(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (1, "-")], "doc_id long, text string")
    assert docs.select(merkle.leaf(("doc_id", "text")).alias("leaf")).distinct().count() == 3


def test_an_empty_table(no_docs):
    got = merkle.check_rows(no_docs)
    assert got.count() == 0 and "proof_sha256" in got.columns
    assert merkle.manifest(no_docs, COLUMNS, "source", ["doc_id"]).root is None


def test_joins_stay_in_their_partitioning(spark):
    """One exchange of the nodes on either side; what is exploded, joined and grouped is not shuffled again."""
    nodes = spark.range(100_000).selectExpr("cast(id % 3 as string) as tree", "id div 3 as idx", "33334L as n", "cast(id as string) as digest")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with merkle.joined_in_place(spark):
            plan = merkle.with_siblings(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange hashpartitioning") == 3


def test_the_setting_is_restored(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), merkle.joined_in_place(spark):
        1 / 0
    assert spark.conf.get(name) == before


def test_arity_must_branch(odd):
    with pytest.raises(ValueError):
        merkle.manifest(odd, COLUMNS, "source", ["doc_id"], 1)
