"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over a bounded sort key, sorted inside each partition by their
whole normalised bytes, and neighbours are compared in full. The splitter key is the first bytes of the text and
its SHA-256, so the sample that Spark takes stays small however long the texts are. Equal texts share the key and
meet next to each other; different texts that share a prefix are told apart by the full comparison.

A text copied so often that its group would swell one partition is found beforehand by map-side combined counts of
the SHA-256, and dealt over several sort ranges by its identifier. At most ``1 / hot_share`` texts can be that
frequent, which bounds the broadcast table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    prefix_bytes: int = 64,
    hot_share: float = 0.001,
    hot_rows: int = 1000,
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``normalise`` maps the text column to what is compared (default: unchanged). A null text counts as empty, an
    empty text equals other empty texts. Null identifiers lose against any other; among rows that repeat the
    retained identifier exactly one is kept. An empty table gives an empty result. Columns of ``docs`` that bear
    one of the added names are replaced.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    body = normalise(body) if normalise else body
    own = [c for c in docs.columns if c not in ADDED or c in (id_col, text_col)]
    ident = F.col(f"`{id_col}`")
    named = docs.select(*[F.col(f"`{c}`") for c in own], body.alias("_cs_text"))

    # Hot texts: counted with map-side combine; rows of one such text go to as many ranges as it has shares.
    limit = max(hot_rows, int(docs.count() * hot_share))
    hot = (
        named.select(F.sha2("_cs_text", 256).alias("_cs_sha"), ident.alias("_cs_id"))
        .groupBy("_cs_sha")
        .agg(F.count("*").alias("_cs_count"), best("_cs_id").alias("_cs_best"))
        .where(F.col("_cs_count") > limit)
    )
    keyed = named.select(
        "*",
        F.substring(F.col("_cs_text").cast("binary"), 1, prefix_bytes).alias("_cs_prefix"),
        F.sha2("_cs_text", 256).alias("_cs_sha"),
    ).join(F.broadcast(hot), "_cs_sha", "left")
    ways = F.ceil(F.col("_cs_count") / F.lit(limit))
    keyed = keyed.withColumn("_cs_way", F.when(F.col("_cs_count").isNotNull(), F.pmod(F.xxhash64(ident), ways)).otherwise(F.lit(0).cast("bigint")))

    ranges = keyed.repartitionByRange("_cs_prefix", "_cs_sha", "_cs_way")
    same = Window.partitionBy("_cs_prefix", "_cs_sha", "_cs_text", "_cs_way")
    order = same.orderBy(ident.asc_nulls_last() if keep == "smallest" else ident.desc_nulls_last())
    ranked = ranges.withColumn("_cs_rank", F.row_number().over(order))
    ranked = ranked.withColumn("_cs_here", best(ident).over(same)).withColumn("_cs_size", F.count("*").over(same))
    split = F.col("_cs_count").isNotNull()
    keep_id = F.when(split, F.col("_cs_best")).otherwise(F.col("_cs_here"))
    return ranked.select(
        *[F.col(f"`{c}`") for c in own],
        keep_id.alias("keep_id"),
        F.when(split, F.col("_cs_count")).otherwise(F.col("_cs_size")).alias("group_size"),
        ((F.col("_cs_rank") == 1) & ident.eqNullSafe(keep_id)).alias("kept"),
        F.col("_cs_sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return content_sort(docs, **options).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
