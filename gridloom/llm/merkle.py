"""Merkle manifest of a dataset by sibling-shift self-joins.

Rows are leaves. Each group (a source, a file, a shard) is a tree of its own, whose root is a leaf of the top tree. A
node is a row ``(tree, idx, n, digest)``: its place among the ``n`` nodes of its level. On every level nodes are
joined to themselves by computed sibling indices: ``idx XOR 1`` in a binary tree, in a wider one the other slots of
the run, one offset each. The rows of slot zero, with the digests of their siblings, emit the parents. Proofs go the
other way: every node is joined to its siblings, and to the path of its parent.

Both sides of a join are partitioned by (tree, run), and what they are joined and grouped by further does not shuffle
them again (``joined_in_place``): a level costs one shuffle of its nodes on each side. A run has at most ``arity`` rows,
so no key is hot, whatever the share of a tree. Levels are written, each an ``arity``-th of the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.order import numbered
from gridloom.session import attach, materialise, settings

ARITY = 16
NODE = ("tree", "idx", "n", "digest")
TOP = "top"


def joined_in_place(spark: SparkSession):
    """Lets joins on (tree, run, sibling) use a partitioning by (tree, run), which is even here: runs are short."""
    return settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """A value so that neighbours can't run into each other: ``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row; ``changed`` replaces columns by other values."""
    changed = changed or {}
    return digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def with_siblings(nodes: DataFrame, arity: int = ARITY, slot_zero: bool = False) -> DataFrame:
    """``nodes`` (all of them, or those of slot zero) with ``left`` and ``right``, the joined digests of the siblings on either
    side. Further columns are kept."""
    keyed = nodes.withColumn("run", F.expr(f"idx div {arity}")).repartition("tree", "run")
    asking = keyed.where(F.col("idx") % arity == 0) if slot_zero else keyed
    if arity == 2:
        shifts = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")))
    else:
        first = F.col("run") * arity
        shifts = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda s: first + (F.col("idx") - first + s) % arity)
    wanted = asking.select("tree", "run", "idx", "n", F.explode(shifts).alias("sibling")).where("sibling < n")
    there = keyed.select("tree", "run", F.col("idx").alias("sibling"), F.col("digest").alias("other"))
    found = wanted.join(there, ["tree", "run", "sibling"]).groupBy("tree", "run", "idx").agg(
        F.sort_array(F.collect_list(F.struct("sibling", "other"))).alias("others"))
    side = lambda test: F.array_join(F.transform(F.filter("others", test), lambda s: s["other"]), "")
    found = found.select("tree", "run", "idx", side(lambda s: s["sibling"] < F.col("idx")).alias("left"), side(lambda s: s["sibling"] > F.col("idx")).alias("right"))
    return asking.join(found, ["tree", "run", "idx"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("left", "right")})


def parents(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The next level: one node per run, emitted by its slot zero. Trees of a single node have none."""
    zero = with_siblings(nodes.where("n > 1").select(*NODE), arity, slot_zero=True)
    return zero.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels of all trees, leaves first, written from the second on. As many as the largest tree has."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while largest > 1:
        out.append(materialise(parents(out[-1], arity), "merkle-level"))
        largest = -(-largest // arity)
    return out


def roots(steps: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree."""
    found = [s.where("n = 1").select("tree", F.col("digest").alias("root")) for s in steps]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def paths(steps: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes of the lowest level with ``path``: the siblings (left, right) of every level from the node to the root.

    ``above`` holds ``tree, path`` that every tree's own root goes on with. All levels but the lowest are written.
    """
    done = None
    for k in range(len(steps) - 1, -1, -1):
        tops = attach(steps[k].where("n = 1"), above, "tree").select(*[F.col(f"`{c}`") for c in steps[k].columns], "path")
        if done is None:
            done = tops
        else:
            upper = done.select("tree", F.col("idx").alias("run"), F.col("path").alias("rest")).repartition("tree", "run")
            own = with_siblings(steps[k].where("n > 1"), arity).join(upper, ["tree", "run"])
            own = own.select(*[F.col(f"`{c}`") for c in steps[k].columns], F.concat(F.array(F.struct("left", "right")), F.col("rest")).alias("path"))
            done = own.unionByName(tops)
        if k:
            done = materialise(done.select("tree", "idx", "path"), "merkle-path")
    return done


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


class Manifest:
    """``leaves`` (tree, idx, n, digest and the caller's columns), the levels of all trees and of the top tree."""

    def __init__(self, leaves: DataFrame, arity: int = ARITY):
        self.arity, self.leaves = arity, leaves
        with joined_in_place(leaves.sparkSession):
            self.steps = levels(leaves, arity)
            self.subroots = materialise(roots(self.steps), "merkle-subroots")
            tops = self.subroots.select(F.lit(TOP).alias("top"), "tree", F.col("root").alias("digest"))
            tops = numbered(tops, "top", [F.col("tree")]).select(F.col("top").alias("tree"), "idx", "n", "digest", F.col("tree").alias("of"))
            self.top_steps = levels(tops, arity)
        found = roots(self.top_steps).first()
        self.root = found["root"] if found else None

    def proofs(self, **columns: Column) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and the given ``columns``, which may use these and ``path``; written."""
        none = F.array().cast("array<struct<left:string,right:string>>")
        with joined_in_place(self.leaves.sparkSession):
            start = roots(self.top_steps).select("tree", none.alias("path"))
            above = paths(self.top_steps, start, self.arity).select(F.col("of").alias("tree"), "path")
            known = self.subroots.withColumnRenamed("root", "subroot").withColumn("root", F.lit(self.root).cast("string"))
            out = attach(paths(self.steps, materialise(above, "merkle-top"), self.arity), known, "tree")
            own = [F.col(f"`{c}`") for c in self.leaves.columns]
            return materialise(out.select(*own, "subroot", "root", *[e.alias(c) for c, e in columns.items()]), "merkle-proofs")


def manifest(rows: DataFrame, columns: Sequence[str], group: str | None, order: Sequence[str], arity: int = ARITY,
             changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: leaves over ``columns``, a tree per value of ``group`` (null is one of its own, and first),
    leaves in ascending ``order`` (null first; rows that tie go by their digest).

    Every row is a leaf, repeated rows too. A null column is digested as ``-``, which no value can equal, so null and
    empty differ. An empty table has no leaf, no tree and no root. ``leaves`` keeps ``columns`` under ``row`` without
    texts, that is ``order`` alone, and holds ``changed_digest``, the leaf with ``changed`` columns, for tamper tests.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")) if group else F.lit("")
    slim = rows.select(
        name.alias("tree"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("row"), leaf(columns).alias("digest"),
        leaf(columns, changed).alias("changed_digest"),
    )
    placed = numbered(slim, "tree", [*[F.col(f"row.`{c}`").asc_nulls_first() for c in order], F.col("digest"), F.col("changed_digest")])
    return Manifest(placed, arity)


def check_rows(docs: DataFrame) -> DataFrame:
    """Every row of ``documents`` with its leaf, roots, digested proof, and whether the row still folds to the root after a
    fifth of the rows had their text lower-cased.

    Null identifiers count as not tampered with; rows that repeat others are leaves of their own.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    made = manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "source", ["doc_id"], changed={"text": changed})
    path = F.col("path")
    out = made.proofs(proof_sha256=digest(proof(path)), folded_root=folded(F.col("changed_digest"), path), depth=F.size(path))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), "idx", "depth",
    )
