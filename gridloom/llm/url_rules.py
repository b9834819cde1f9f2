"""URL filters by a sort-merge range join.

A host is turned round label by label (``www.example.com`` to ``com.example.www.``), so that a rule's host and all its
subdomains are one interval of keys, and nested rules are nested intervals. URLs and rules are range-partitioned and
sorted together on that key; a sweep over each partition keeps a stack of the rules that enclose the current key. The
paths of the rules of one host are nested intervals again, ordered once and searched from the innermost outwards.

Splitters come from a sample of both tables and include path and identifier, so a host that holds a third of all
URLs is split. A rule whose interval reaches into a later partition is carried there: the key at which a partition
starts names all rules that can enclose it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host: Column) -> Column:
    """``com.example.www.`` for ``www.example.com``; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Level:
    """The rules of one host. Their paths are intervals in path order; each knows the next wider one around it."""

    def __init__(self, key: str, size: int):
        self.key, self.size = key, size  # size: length of the host
        self.rules: dict[str, str] = {}
        self.paths: list[str] | None = None
        self.outer: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        """Of rules for the same host and path, ``block`` stands."""
        if self.rules.get(path) != "block":
            self.rules[path] = verdict
        self.paths = None

    def _sort(self) -> None:
        self.paths, self.outer, open_ = sorted(self.rules), [], []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.outer.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> str | None:
        if self.paths is None:
            self._sort()
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.paths[i] if i >= 0 else None


class Sweep:
    """The state of a sweep through rows sorted by partition, key and kind (rules first)."""

    def __init__(self):
        self.part, self.stack = None, []

    def move(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Level(key, len(host)))
        self.stack[-1].add(path, verdict)

    def best(self, path: str) -> tuple[str, str, str] | None:
        """Key, path and verdict of the longest rule (host and path together; of equals, the longer host)."""
        found = None
        for level in self.stack:
            hit = level.longest(path)
            if hit is not None:
                rank = (level.size + len(hit), level.size)
                if found is None or rank >= found[0]:
                    found = (rank, (level.key, hit, level.rules[hit]))
        return found[1] if found else None


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` of every URL; ``default`` is the verdict where no rule fits.

    ``rules``: host, path (both without a wildcard; a host fits itself and its subdomains, the empty host any), verdict.
    A null host or path of a rule counts as empty. Rows that repeat an identifier or a URL are judged each for itself;
    an empty rule table gives the default throughout, an empty URL table an empty result.
    """
    kind = urls.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")).select(
        reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "path", "id", "host", F.lit("").alias("verdict")
    )
    rule_host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    ruled = rules.select(
        reversed_key(rule_host).alias("key"), F.lit(0).alias("kind"), F.coalesce("path", F.lit("")).alias("path"),
        F.lit(None).cast(kind).alias("id"), rule_host.alias("host"), "verdict",
    )
    ranged = materialise(
        rows.unionByName(ruled).repartitionByRange("key", "kind", "path", "id").withColumn("part", F.spark_partition_id()), "url-ranges"
    )
    # Rules that enclose the first key of a partition: one lookup for each label prefix of that key.
    first = ranged.where("kind = 1").groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split(F.expr("substring(first, 1, length(first) - 1)"), r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    carried = first.select("part", F.explode(F.array_distinct(prefixes)).alias("key")).join(ruled.distinct(), "key")
    swept = (
        ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", "key", "kind", "path")
        .select("part", "key", "kind", "path", "id", "host", "verdict")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for batch in batches:
            part, key, is_url, path, ident, host, verdict = (c for c in batch.columns)
            keep, rule_text, verdicts = [], [], []
            for k, (p, y, u, t, h, v) in enumerate(zip(*(c.to_pylist() for c in (part, key, is_url, path, host, verdict)))):
                state.move(p, y)
                if not u:
                    state.rule(y, h, t, v)
                    continue
                hit = state.best(t)
                keep.append(k)
                rule_text.append(".".join(hit[0][:-1].split(".")[::-1]) + hit[1] if hit else None)
                verdicts.append(hit[2] if hit else default)
            rows = pa.array(keep, pa.int64())
            yield pa.record_batch(
                [ident.take(rows), host.take(rows), path.take(rows), pa.array(rule_text, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return swept.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
