"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has many points on a ring, drawn by hash. A key belongs to the first point clockwise from its own hash; if
that point's shard is full, it goes on clockwise to the next shard that has room. A shard's room is bounded, so balance
is guaranteed; and as a key moves only if the arc that it lies on, or the room of the shards behind it, changes, few
keys move when shards come or go.

Keys of one arc (the ring between two neighbouring points) meet the shards in the same order. So only the loads of arcs
matter, a table whose size is that of the ring. Rounds run on that table: in round ``r`` what is left of an arc asks its
``r``-th shard; a shard takes what asks it in the order of the ring, until it is full, which cuts at most one arc. An
arc then falls into stretches, one for each shard that took from it. Keys are ordered along the ring once, by a range
partitioning that spreads arcs of any weight, and each finds the stretch of its place.

Everything is column code. The ring's tables are bounded by shards, points and rounds, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.order import numbered
from gridloom.session import materialise

POINTS = 64  # of every shard
DIGITS = 15  # hexadecimal digits of a position on the ring
CELL_DIGITS = 3  # the ring is looked up by its first digits


def position(name: Column) -> Column:
    """The place of a name on the ring."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int, points: int = POINTS) -> DataFrame:
    """``arc, point, turns``: the points in order, and for each the shards in the order in which they follow clockwise."""
    names = spark.range(shards * points).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("copy"))
    placed = names.select("shard", position(F.concat_ws(":", "shard", "copy")).alias("point"))
    # A point that two shards draw belongs to the lesser one.
    placed = placed.groupBy("point").agg(F.min("shard").alias("shard"))
    whole = F.sort_array(F.collect_list(F.struct("point", "shard")))
    around = placed.groupBy().agg(whole.alias("around"))  # the ring itself: shards * points entries
    arcs = around.select("around", F.posexplode("around").alias("arc", "here"))
    size = F.size("around")
    turn = F.concat(F.slice("around", F.col("arc") + 1, size), F.slice("around", F.lit(1), F.col("arc")))
    return arcs.select("arc", F.col("here.point").alias("point"), F.array_distinct(F.transform(turn, lambda p: p["shard"])).alias("turns"))


def cells(arcs: DataFrame) -> DataFrame:
    """``cell, inside``: for every stretch of the ring with the same first digits, its points in order and the one after."""
    spark, width = arcs.sparkSession, 16 ** (DIGITS - CELL_DIGITS)
    cell = spark.range(16**CELL_DIGITS).select(F.col("id").alias("cell"))
    held = arcs.groupBy(F.expr(f"point div {width}").alias("cell")).agg(F.sort_array(F.collect_list(F.struct("point", "arc"))).alias("points"))
    after = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)  # of 16 ** CELL_DIGITS rows
    first = F.first(F.col("points")[0]["arc"], ignorenulls=True).over(after)
    empty = F.array().cast("array<struct<point:bigint,arc:int>>")
    return cell.join(F.broadcast(held), "cell", "left").select("cell", F.coalesce("points", empty).alias("points"), F.coalesce(first, F.lit(0)).alias("next"))


def arc_of(keys: DataFrame, arcs: DataFrame) -> DataFrame:
    """``keys`` with ``arc``, by their ``place`` on the ring."""
    width = 16 ** (DIGITS - CELL_DIGITS)
    found = keys.withColumn("cell", F.expr(f"place div {width}")).join(F.broadcast(cells(arcs)), "cell")
    ahead = F.filter("points", lambda p: p["point"] >= F.col("place"))
    return found.withColumn("arc", F.when(F.size(ahead) > 0, ahead[0]["arc"]).otherwise(F.col("next"))).drop("cell", "points", "next")


def capacities(spark: SparkSession, shards: int, total: int, slack: float) -> DataFrame:
    """``shard, room``: together at least ``total``; without slack exactly that, at most one apart."""
    base = int(total * (1 + slack))
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(base // shards) + (F.col("id") < base % shards).cast("bigint")).alias("room"))


def stretches(arcs: DataFrame, loads: DataFrame, rooms: DataFrame, shards: int) -> DataFrame:
    """Written table ``arc, low, high, shard, turn``: which shard takes an arc's load from ``low`` to ``high``.

    ``loads``: ``arc, load``. After as many rounds as there are shards nothing is left, as there is room for all.
    """
    left = arcs.join(loads, "arc").where("load > 0").select("arc", "turns", F.col("load").alias("rest"), F.lit(0).cast("bigint").alias("low"))
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    rounds = []
    for k in range(shards):
        room = F.col("room")
        if rounds:
            used = reduce(DataFrame.unionByName, rounds).groupBy("shard").agg(F.sum("take").alias("used"))
            free, room = rooms.join(F.broadcast(used), "shard", "left"), F.col("room") - F.coalesce("used", F.lit(0))
        else:
            free = rooms
        free = free.select("shard", room.alias("room"))
        asking = left.withColumn("shard", F.col("turns")[k]).join(F.broadcast(free), "shard")
        here = F.greatest(F.col("room") - F.coalesce(F.sum("rest").over(before), F.lit(0)), F.lit(0))
        asking = materialise(asking.select("arc", "turns", "rest", "low", "shard", F.least("rest", here).alias("take"), F.lit(k).alias("turn")).coalesce(1), "ring-round")
        rounds.append(asking)
        left = asking.where("take < rest").select("arc", "turns", (F.col("rest") - F.col("take")).alias("rest"), (F.col("low") + F.col("take")).alias("low"))
        if left.isEmpty():
            break
    taken = reduce(DataFrame.unionByName, rounds).where("take > 0")
    return materialise(taken.select("arc", "low", (F.col("low") + F.col("take")).alias("high"), "shard", "turn").coalesce(1), "ring-stretches")


def assign(rows: DataFrame, shards: int, key: str = "doc_id", size: str | None = None, slack: float = 0.0, points: int = POINTS,
           ties: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (from 0 within the shard, without gaps) and ``home``, the shard of the key's own arc.

    A shard holds at most ``(1 + slack) / shards`` of all rows, rounded up; without slack, counts differ by one at most.
    With ``size``, a column of sizes of 1 or more, loads are bounded by size instead: a row belongs to where it begins, so
    a shard can exceed its bound by its last row, or fall short by its first, once for every stretch that was cut.

    A null key is a key of its own. Rows that repeat a key lie at one place of the ring and may be cut apart; they go by the
    columns ``ties``, and if these are equal as well, either may come first. Slots follow the order of the ring. An empty
    table gives an empty result. Columns that bear added names are replaced.
    """
    if shards < 1 or slack < 0:
        raise ValueError("shards must be 1 or more, slack 0 or more")
    spark = rows.sparkSession
    added = ("shard", "slot", "home")
    own = [c for c in rows.columns if c not in added]
    arcs = materialise(ring(spark, shards, points).coalesce(1), "ring")
    slim = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    slim = slim.withColumn("place", position(F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit(""))))
    slim = arc_of(slim, arcs)
    load = None if size is None else F.col(f"row.`{size}`")
    order = [F.col("place"), F.col(f"row.`{key}`"), *[F.col(f"row.`{c}`") for c in ties]]
    placed = numbered(slim, "arc", order, load)
    at = F.col("idx") if size is None else F.col("ahead")
    loads = materialise(placed.groupBy("arc").agg(F.count("*").alias("load") if size is None else F.sum(load).alias("load")).coalesce(1), "ring-loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    cut = stretches(arcs, loads, capacities(spark, shards, total, slack), shards)
    # At most one stretch per arc, and one more for every shard and round.
    per_arc = cut.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("low", "high", "shard", "turn"))).alias("parts"))
    found = placed.join(F.broadcast(per_arc), "arc").withColumn("at", at)
    found = found.withColumn("part", F.filter("parts", lambda p: (p["low"] <= F.col("at")) & (F.col("at") < p["high"]))[0]).drop("parts")
    found = found.select("row", "arc", "idx", F.col("part.shard").alias("shard"), F.col("part.low").alias("low"))
    counts = found.groupBy("shard", "arc", "low").agg(F.count("*").alias("rows"), F.min("idx").alias("first"))
    counts = materialise(counts.coalesce(1), "ring-counts")
    before = Window.partitionBy("shard").orderBy("arc", "low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "arc", "low", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    homes = arcs.select("arc", F.col("turns")[0].alias("home"))
    out = found.join(F.broadcast(offsets), ["shard", "arc", "low"]).join(F.broadcast(homes), "arc")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", (F.col("idx") + F.col("shift")).alias("slot"), "home")


def described(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``documents`` in its shard: counts of shards differ by one at most. A null text counts as no bytes."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    out = assign(slim, shards, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
