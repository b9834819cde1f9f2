"""Regridding as a sparse weighted join.

Weights are a table (src_iy, src_ix, dst_iy, dst_ix, w), computed once per pair of grids and reusable. Axis
tables have one row per grid line, so that overlap is searched in longitude and latitude separately; grid
cells are never paired all against all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import finite
from gridloom.operators.geometry import axis_bounds
from gridloom.session import DENSE_BYTES, DENSE_ROWS, attach, materialise

WEIGHTS = ("src_iy", "src_ix", "dst_iy", "dst_ix", "w")
BLOCK_WEIGHTS = 20_000  # weights of one block of target cells, on the second way of a chain
BLOCK = "_block"
TASK_ROWS = 1_000_000  # contributions to target cells that one task sums and sorts

# Fixed value: standard temperature lapse rate, kelvin per metre.
LAPSE_RATE = -0.0065


@dataclass(frozen=True)
class Chain:
    """Weights of regridding twice, kept as the weights of either way.

    As one table they have a row for any two cells that share a cell between them, which is the square of the grids where the
    grid between is coarse. ``regrid`` goes both ways instead; ``pairs`` and ``per_target`` tell that table and its sums.
    """

    first: DataFrame
    second: DataFrame

    def _ways(self) -> tuple[DataFrame, DataFrame]:
        a = self.first.select("src_iy", "src_ix", F.col("dst_iy").alias("m_iy"), F.col("dst_ix").alias("m_ix"), F.col("w").alias("w1"))
        b = self.second.select(F.col("src_iy").alias("m_iy"), F.col("src_ix").alias("m_ix"), "dst_iy", "dst_ix", F.col("w").alias("w2"))
        return a, b

    def pairs(self) -> DataFrame:
        """(src, dst, w) in full, for grids whose cells have few others in reach."""
        a, b = self._ways()
        return a.join(b, ["m_iy", "m_ix"]).groupBy("src_iy", "src_ix", "dst_iy", "dst_ix").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))

    def per_target(self) -> DataFrame:
        """(dst_iy, dst_ix, total, n): the sum and the number of the weights of each target cell, without making their rows.

        Cells that meet the same cells between form a kind; kinds meet instead of cells, and a source counts once for a target
        however many ways lead there.
        """
        a, b = self._ways()
        mid, src, dst = ["m_iy", "m_ix"], ["src_iy", "src_ix"], ["dst_iy", "dst_ix"]
        reach = F.array_sort(F.collect_set(F.struct(*mid)))
        known = lambda t: t.where("m_iy is not null and m_ix is not null")
        kinds = known(a).groupBy(*src).agg(reach.alias("_from")).groupBy("_from").agg(F.count(F.lit(1)).alias("_cells"))
        targets = known(b).groupBy(*dst).agg(reach.alias("_to"))
        spread = lambda t, c: t.select(c, F.explode(c).alias("_m")).distinct()
        met = spread(kinds, "_from").join(spread(targets, "_to"), "_m").select("_from", "_to").distinct()
        counts = met.join(kinds, "_from").groupBy("_to").agg(F.sum("_cells").alias("n"))
        sums = b.join(a.groupBy(*mid).agg(F.sum("w1").alias("_w")), mid).groupBy(*dst).agg(F.sum(F.col("w2") * F.col("_w")).alias("total"))
        both = sums.select(F.struct(*dst).alias("_dst"), "total").join(targets.join(counts, "_to").select(F.struct(*dst).alias("_dst"), "n"), "_dst")
        return both.select("_dst.*", "total", "n")


@dataclass(frozen=True)
class Deal:
    """How target cells at every time are dealt: by time and block of cells, in a number of partitions that keeps tasks bounded.

    Fields regridded by one deal, and other rows of their cells ``dealt`` by it, lie in the same partitions (column ``BLOCK``), so
    that what looks at all rows of a cell needs no shuffle of them.
    """

    blocks: int
    parts: int

    @staticmethod
    def of(chain: Chain, times: int) -> Deal:
        count = chain.second.count()
        least = int(chain.second.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Deal(-(-count // BLOCK_WEIGHTS) or 1, max(least, -(-count * times // TASK_ROWS)))

    def block(self, iy: str = "iy", ix: str = "ix") -> Column:
        # The hash of a number depends on its type.
        return F.pmod(F.hash(F.col(iy).cast("bigint"), F.col(ix).cast("bigint")), F.lit(self.blocks))

    def dealt(self, rows: DataFrame, keys=("time",)) -> DataFrame:
        return rows.withColumn(BLOCK, self.block()).repartition(self.parts, *keys, BLOCK)


def regrid(field: DataFrame, weights: DataFrame | Chain, keys=("time",), values=("value",), renormalise: bool = False, deal: Deal | None = None) -> DataFrame:
    """dst = sum(w * src) for each of ``keys``.

    A NULL or missing contributor nulls the target cell; with ``renormalise`` the present ones are
    rescaled to full weight instead. Contributions are summed before the shuffle (partial aggregation),
    so a hot source cell or time costs no more than its share of the scan. A :class:`Chain` is gone along twice; with
    ``deal`` and ``renormalise`` its result is dealt by it and keeps the column ``BLOCK``.
    """
    keys, values = list(keys), list(values)
    if isinstance(weights, Chain):
        return _regrid_chain(field, weights, keys, values, renormalise, deal)
    need = Window.partitionBy("dst_iy", "dst_ix")
    sized = weights.withColumn("_need", F.count(F.lit(1)).over(need))
    src = field.select(*keys, F.col("iy").alias("src_iy"), F.col("ix").alias("src_ix"), *values)
    joined = attach(src, sized, ["src_iy", "src_ix"])
    aggs = []
    for v in values:
        total = F.sum(F.col("w") * F.col(v))
        if renormalise:
            out = F.try_divide(total, F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))
        else:
            out = F.when(F.count(v) == F.max("_need"), total)
        aggs.append(out.alias(v))
    return joined.groupBy(*keys, F.col("dst_iy").alias("iy"), F.col("dst_ix").alias("ix")).agg(*aggs)


def _regrid_chain(field: DataFrame, chain: Chain, keys: list[str], values: list[str], renormalise: bool, deal: Deal | None = None) -> DataFrame:
    if not renormalise:
        return regrid(regrid(field, chain.first, keys, values), chain.second, keys, values)

    # Sums and the weights present in them travel apart, so that both are those of the chained weights.
    def way(rows: DataFrame, weights: DataFrame, sums: dict[str, Column], by=()) -> DataFrame:
        joined = attach(rows.withColumnsRenamed({"iy": "src_iy", "ix": "src_ix"}), weights, [*by, "src_iy", "src_ix"], max_rows=DENSE_ROWS, max_bytes=DENSE_BYTES)
        return joined.groupBy(*keys, *by, F.col("dst_iy").alias("iy"), F.col("dst_ix").alias("ix")).agg(*[F.sum(F.col("w") * c).alias(n) for n, c in sums.items()])

    names = [(f"_sum_{i}", f"_mass_{i}") for i in range(len(values))]
    start = {}
    for v, (total, mass) in zip(values, names):
        start |= {total: F.col(v), mass: F.when(F.col(v).isNotNull(), F.lit(1.0))}
    between = way(field.select(*keys, "iy", "ix", *values), chain.first.select(*WEIGHTS), start)
    # What is between may be a few rows that each spread over many cells: they are dealt by keys and block of target cells, in
    # which a target's contributions stay together, so the spread rows are not shuffled again.
    kept = [BLOCK] if deal else []
    deal = deal or Deal.of(chain, 0)
    dealt = between.withColumn(BLOCK, F.explode(F.sequence(F.lit(0), F.lit(deal.blocks - 1))))
    dealt = dealt.repartition(deal.parts, *keys, BLOCK)
    out = way(dealt, chain.second.select(*WEIGHTS, deal.block("dst_iy", "dst_ix").alias(BLOCK)), {n: F.col(n) for n in start}, [BLOCK])
    return out.select(*keys, "iy", "ix", *[F.try_divide(total, mass).alias(v) for v, (total, mass) in zip(values, names)], *kept)


def _axis(grid: DataFrame, coord: str, index: str) -> DataFrame:
    return grid.select(F.col(coord).alias("c"), F.col(index).alias("i")).distinct()


def axis_overlap(src: DataFrame, dst: DataFrame, coord: str, index: str, width: float, measure) -> DataFrame:
    """Overlapping (src_i, dst_i, size) of two 1-D axes; ``measure(lo, hi)`` gives the size of an interval.

    Both sides are laid out on bins of ``width`` and met by bin; a pair is kept only in the first bin that
    both touch, so it appears once.
    """
    def binned(axis, side):
        b = axis_bounds(_axis(axis, coord, index), "c")
        return b.select(
            F.col("i").alias(f"{side}_i"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"),
            F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bin"),
        )

    lo, hi = F.greatest("s_lo", "d_lo"), F.least("s_hi", "d_hi")
    return (
        binned(src, "s").join(binned(dst, "d"), "bin")
        .where((hi > lo) & (F.col("bin") == F.floor(lo / width)))
        .select(F.col("s_i").alias("src_i"), F.col("d_i").alias("dst_i"), measure(lo, hi).alias("size"))
    )


def conservative_weights(src: DataFrame, dst: DataFrame, bin_degrees: float = 10.0) -> DataFrame:
    """Area-overlap weights between rectilinear grids, normalised by the covered part of each target cell."""
    lon = axis_overlap(src, dst, "lon", "ix", bin_degrees, lambda a, b: b - a)
    lat = axis_overlap(src, dst, "lat", "iy", bin_degrees, lambda a, b: F.sin(F.radians(b)) - F.sin(F.radians(a)))
    lon = lon.select(F.col("src_i").alias("src_ix"), F.col("dst_i").alias("dst_ix"), (F.col("size") / F.sum("size").over(Window.partitionBy("dst_i"))).alias("wx"))
    lat = lat.select(F.col("src_i").alias("src_iy"), F.col("dst_i").alias("dst_iy"), (F.col("size") / F.sum("size").over(Window.partitionBy("dst_i"))).alias("wy"))
    return _product(dst, lat, lon)


def _product(dst: DataFrame, lat: DataFrame, lon: DataFrame) -> DataFrame:
    """Weights of a target cell: row weights times column weights (grids are products of their axes)."""
    cells = dst.select(F.col("iy").alias("dst_iy"), F.col("ix").alias("dst_ix")).distinct()
    return (
        cells.join(lat, "dst_iy").join(lon, "dst_ix")
        .select("src_iy", "src_ix", "dst_iy", "dst_ix", (F.col("wx") * F.col("wy")).alias("w"))
        .where("w > 0")
    )


def axis_linear(src: DataFrame, dst: DataFrame, coord: str, index: str, width: float) -> DataFrame:
    """Linear interpolation weights along one axis (src_i, dst_i, w); outside the hull the nearest end has 1."""
    s = _axis(src, coord, index)
    order = Window.orderBy("c")  # one row per grid line
    # The last line closes with a segment of zero length.
    seg = s.select("c", "i", F.lead("c").over(order).alias("c2"), F.lead("i").over(order).alias("i2"))
    ends = s.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    d = _axis(dst, coord, index)
    at = F.greatest(F.least(F.col("c"), ends.select("hi").scalar()), ends.select("lo").scalar())
    targets = d.select(F.col("i").alias("dst_i"), at.alias("t")).withColumn("bin", F.floor(F.col("t") / width))
    binned = seg.withColumn("bin", F.explode(F.sequence(F.floor(F.col("c") / width), F.floor(F.coalesce(F.col("c2"), F.col("c")) / width))))
    hit = targets.join(binned, "bin").where((F.col("t") >= F.col("c")) & ((F.col("t") < F.col("c2")) | (F.col("c2").isNull() & (F.col("t") == F.col("c")))))
    f = F.coalesce((F.col("t") - F.col("c")) / (F.col("c2") - F.col("c")), F.lit(0.0))
    pair = F.array(F.struct(F.col("i").alias("src_i"), (1.0 - f).alias("w")), F.struct(F.col("i2").alias("src_i"), f.alias("w")))
    return hit.select("dst_i", F.explode(pair).alias("p")).select("dst_i", "p.src_i", "p.w").where("w > 0")


def bilinear_weights(src: DataFrame, dst: DataFrame, bin_degrees: float = 10.0) -> DataFrame:
    """Bilinear weights between rectilinear grids; targets outside the hull take the nearest source line."""
    lon = axis_linear(src, dst, "lon", "ix", bin_degrees)
    lat = axis_linear(src, dst, "lat", "iy", bin_degrees)
    lon = lon.select(F.col("src_i").alias("src_ix"), F.col("dst_i").alias("dst_ix"), F.col("w").alias("wx"))
    lat = lat.select(F.col("src_i").alias("src_iy"), F.col("dst_i").alias("dst_iy"), F.col("w").alias("wy"))
    return _product(dst, lat, lon)


def chain_weights(first: DataFrame, second: DataFrame) -> Chain:
    """Weights of regridding twice (fine to bridge to target), for :func:`regrid`."""
    return Chain(first, second)


def nearest_cells(points: DataFrame, grid: DataFrame, bucket: float, point: str = "point_id") -> DataFrame:
    """The grid cell nearest to each point (plain distance in lon/lat; ties to the lowest iy, ix).

    Points look into the buckets around their own, ring by ring: first the 3 x 3 neighbourhood, which decides
    for every point whose hit lies within one bucket width. The rest (points far from the grid) look into
    neighbourhoods of coarser buckets, four times as wide each round, until every point is settled.
    """
    settled = None
    # A point without a (finite) position has no nearest cell; an empty grid has none at all.
    placed = lambda df: df.withColumns({c: finite(c) for c in ("lon", "lat")}).where("lon is not null and lat is not null")
    todo, width, grid = placed(points).select(point, "lon", "lat"), bucket, placed(grid)
    if grid.isEmpty():
        return grid.select(F.lit(None).cast(dict(points.dtypes)[point]).alias(point), "iy", "ix").limit(0)
    while True:
        # Each round is written out: the next one starts from its rows, not from all rounds before it.
        found = materialise(_nearest_in_ring(todo, grid, width, point), "nearest")
        good = found.where(F.col("_d2") <= F.lit(width * width)).select(point, "iy", "ix")
        settled = good if settled is None else settled.unionByName(good)
        rest = todo.join(good.select(point), point, "left_anti")
        if rest.isEmpty():
            return settled
        todo = materialise(rest, "nearest-rest")
        width *= 4


def _nearest_in_ring(points: DataFrame, grid: DataFrame, width: float, point: str) -> DataFrame:
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    look = points.select(
        point, F.col("lon").alias("_plon"), F.col("lat").alias("_plat"),
    ).withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).select(
        point, "_plon", "_plat",
        (F.floor(F.col("_plon") / width) + F.col("_dx")).alias("_bx"), (F.floor(F.col("_plat") / width) + F.col("_dy")).alias("_by"),
    )
    cells = grid.select(
        "iy", "ix", "lon", "lat", F.floor(F.col("lon") / width).alias("_bx"), F.floor(F.col("lat") / width).alias("_by")
    )
    dx, dy = F.col("lon") - F.col("_plon"), F.col("lat") - F.col("_plat")
    d2 = dx * dx + dy * dy
    best = F.min(F.struct(d2.alias("_d2"), F.col("iy"), F.col("ix"))).alias("_best")
    return look.join(cells, ["_bx", "_by"]).groupBy(point).agg(best).select(point, "_best.*")


def scatter_points(values: DataFrame, cells: DataFrame, keys=("time",), point: str = "point_id", value: str = "value") -> DataFrame:
    """Put point values on their nearest cells; where points collide the highest point id wins."""
    placed = attach(values, cells, point, derived=True)
    return placed.groupBy(*keys, "iy", "ix").agg(F.max_by(value, point).alias(value))


def lapse_rate_correction(field: DataFrame, source_height: DataFrame, target_height: DataFrame, value: str = "value",
                          source_weights: DataFrame | None = None, target_weights: DataFrame | None = None) -> DataFrame:
    """value + (target height on the source grid - source height) * lapse rate, for tas only.

    Heights are (iy, ix, height) tables; a missing height counts as 0. Heights on other grids are first brought to the grid
    of the field by their weights (bilinear as a rule).
    """
    def heights(table: DataFrame, weights: DataFrame | None, name: str) -> DataFrame:
        rows = table.select("iy", "ix", F.coalesce("height", F.lit(0.0)).alias("height"))
        on_field = rows if weights is None else regrid(rows, weights, keys=(), values=("height",), renormalise=True)
        return on_field.select("iy", "ix", F.col("height").alias(name))

    delta = (
        heights(target_height, target_weights, "_ht").join(heights(source_height, source_weights, "_hs"), ["iy", "ix"], "full_outer")
        .select("iy", "ix", (F.coalesce("_ht", F.lit(0.0)) - F.coalesce("_hs", F.lit(0.0))).alias("_dh"))
    )
    out = attach(field, delta, ["iy", "ix"], "left")
    corrected = F.col(value) + F.coalesce("_dh", F.lit(0.0)) * LAPSE_RATE
    only_tas = F.when(F.col("variable") == "tas", corrected).otherwise(F.col(value)) if "variable" in field.columns else corrected
    return out.withColumn(value, only_tas).drop("_dh")


def compare_modes(modes: dict[str, DataFrame], reference: DataFrame, time: str = "time") -> DataFrame:
    """Difference of several regrid modes to a reference, per time and mode."""
    tagged = None
    for name, df in modes.items():
        one = df.select(F.lit(name).alias("mode"), time, "iy", "ix", "value")
        tagged = one if tagged is None else tagged.unionByName(one)
    joined = tagged.join(reference.select(time, "iy", "ix", F.col("value").alias("_ref")), [time, "iy", "ix"])
    d = F.col("value") - F.col("_ref")
    return joined.groupBy(time, "mode").agg(
        F.avg(F.abs(d)).alias("mad"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(F.abs(d)).alias("max_abs"), F.avg(d).alias("mean_diff"),
    )
