"""Exact distributed empirical distributions: quantiles, quantile tables and Wasserstein distances.

The built-in ``percentile`` gathers every distinct value of a group in one task. Where callers expect
small groups and a count confirms it, quantiles come from their sorted values, a bounded array each. Else values are first
counted per (group, value), map-side first, and the counts written. A group of few different values is then ranked by one window.
A larger one is cut along the value order into buckets, and a bucket that is still too large is cut again: how often
follows from the counts, so no task ranks more than ``LARGEST`` values, whatever share of the rows a group holds. Cuts come
from a bounded sketch; they decide only where work runs, never the result. Running counts are exact: within a bucket by
a window, across buckets by a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import col, count_le
from gridloom.session import attach, materialise

LARGEST = 262_144  # different values that one task ranks
SMALL = 40_000  # rows of a group up to which they are sorted as one array: a century of days
CUTS = 63  # a bucket is cut into up to CUTS + 1


def _buckets(counts: DataFrame, keys: list[str], value: str, largest: int) -> tuple[DataFrame, list[str]]:
    """``counts`` with bucket columns such that no (keys, buckets) has more than ``largest`` rows, and their names."""
    placed, names = counts, []
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    while True:
        group = [*keys, *names]
        sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        if (sizes.agg(F.max("_size")).first()[0] or 0) <= largest:
            return placed, names
        name = f"_bucket{len(names)}"
        cuts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"), F.percentile_approx(F.col(value), probs, 20 * (CUTS + 1)).alias("_cuts"))
        # Structs compare null keys as equal.
        key = F.struct(*[F.col(c) for c in group]) if group else F.lit(0)
        cuts = cuts.where(F.col("_size") > largest).select(key.alias("_group"), "_cuts")
        cut = attach(placed.withColumn("_group", key), cuts, "_group", "left", derived=True)
        bucket = F.coalesce(count_le("_cuts", F.col(value), bits=CUTS.bit_length()), F.lit(0))
        placed = materialise(cut.withColumn(name, bucket).drop("_group", "_cuts"), "value-buckets")
        names.append(name)


def ranked_values(df: DataFrame, keys, value: str, weights: dict[str, Column] | None = None, wanted=None,
                  following=(), largest: int = LARGEST) -> DataFrame:
    """One row per (keys, value) with, for every counter c, ``c`` (rows at this value), ``c_before`` (rows
    below it), ``c_total``, and ``next_value`` (the next larger value of the group, NULL at the end). For every counter in
    ``following``, ``c_next`` is the next larger value that the counter counts.

    ``weights`` maps counter names to per-row integer columns (default: ``n`` = 1 each).
    ``wanted(before, size, total)`` may give a condition on bucket level for the first counter; buckets that fail it are
    dropped before any sorting.
    """
    keys, weights = list(keys), weights or {"n": F.lit(1)}
    names, v = list(weights), F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(*[F.sum(w).cast("bigint").alias(c) for c, w in weights.items()])
    placed, buckets = _buckets(materialise(counts, "value-counts"), keys, value, largest)
    group = [*keys, *buckets]
    inside = Window.partitionBy(*group).orderBy(value)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    # The nearest counted value above, as the last one seen on the way down.
    down = Window.partitionBy(*group).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c: F.last(F.when(F.col(c) > 0, v), ignorenulls=True).over(down)
    if not buckets:
        whole = Window.partitionBy(*keys)
        return placed.select(
            *keys, value, *names, F.lead(v).over(inside).alias("next_value"), *[above(c).alias(f"{c}_next") for c in following],
            *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{c}_before") for c in names], *[F.sum(c).over(whole).alias(f"{c}_total") for c in names],
        )

    per_bucket = placed.groupBy(*group).agg(
        F.min(v).alias("_low"), *[F.sum(c).alias(f"_{c}_size") for c in names], *[F.min(F.when(F.col(c) > 0, v)).alias(f"_{c}_low") for c in following])
    along, back = (Window.partitionBy(*keys).orderBy(*order) for order in (buckets, [F.col(b).desc() for b in buckets]))
    whole, before = Window.partitionBy(*keys), along.rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*[F.col(c) for c in group]).alias("_group")
    borders = per_bucket.select(
        key, F.lead("_low").over(along).alias("_next_low"),
        *[F.last(f"_{c}_low", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{c}_next_low") for c in following],
        *[F.coalesce(F.sum(f"_{c}_size").over(before), F.lit(0)).alias(f"_{c}_offset") for c in names],
        *[F.sum(f"_{c}_size").over(whole).alias(f"{c}_total") for c in names],
        *[F.col(f"_{c}_size") for c in names],
    )
    if wanted is not None:
        c = names[0]
        borders = borders.where(wanted(F.col(f"_{c}_offset"), F.col(f"_{c}_size"), F.col(f"{c}_total")))
    return attach(placed.withColumn("_group", key), borders, "_group", derived=True).select(
        *keys, value, *names, F.coalesce(F.lead(v).over(inside), F.col("_next_low")).alias("next_value"),
        *[F.coalesce(above(c), F.col(f"_{c}_next_low")).alias(f"{c}_next") for c in following],
        *[(F.col(f"_{c}_offset") + F.coalesce(F.sum(c).over(run), F.lit(0))).alias(f"{c}_before") for c in names],
        *[F.col(f"{c}_total") for c in names],
    )


def small_groups(df: DataFrame, keys, largest: int = SMALL) -> bool:
    """Whether no group has more than ``largest`` rows, by a count that is combined map-side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return (sizes.agg(F.max("_size")).first()[0] or 0) <= largest


def _sorted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _all, _n): the sorted values of groups that are known to be small, by one shuffle of the values."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value))).alias("_all"))
    return rows.withColumn("_n", F.size("_all").cast("bigint")).where("_n > 0")


def _rank(p, total):
    return F.floor(p * (total - 1).cast("double")).cast("bigint")


def quantiles_of(ranked: DataFrame, keys, value: str, probs, counter: str = "n", following: str = "next_value", name: str = "quantiles") -> DataFrame:
    """Per group the exact linearly interpolated quantiles of the rows that ``counter`` counts, from ranked values;
    ``following`` is the column with the next larger value of that counter."""
    p_array = F.array(*[F.lit(float(p)) for p in probs])
    start, v, total = F.col(f"{counter}_before"), F.col(value), F.col(f"{counter}_total")
    end = start + F.col(counter)
    hits = F.filter(
        F.transform(p_array, lambda p, i: F.struct(i.alias("i"), p.alias("p"))),
        lambda h: (_rank(h["p"], total) >= start) & (_rank(h["p"], total) < end),
    )
    exploded = ranked.withColumn("_hit", F.explode(hits))
    exact = F.col("_hit.p") * (total - 1).cast("double")
    lower = _rank(F.col("_hit.p"), total)
    upper_value = F.when(lower + 1 < end, v).otherwise(F.coalesce(F.col(following), v))
    q = v + (exact - lower.cast("double")) * (upper_value - v)
    return _as_array(exploded.select(*keys, F.col("_hit.i").alias("_i"), q.alias("_q")), keys, name)


def exact_quantiles(df: DataFrame, keys, value: str, probs, name: str = "quantiles", largest: int = LARGEST, cells: bool = False) -> DataFrame:
    """Per group the exact linearly interpolated quantiles, as an array in the order of ``probs``.

    Groups without any value give no row. ``cells`` says that there are many groups, small ones as a rule: where a count finds
    all of them small, values are sorted as one array each, which takes a single shuffle.
    """
    p_array = F.array(*[F.lit(float(p)) for p in probs])
    if cells and keys and small_groups(df.where(F.col(value).isNotNull()), list(keys), min(largest, SMALL)):
        def at(p):
            lower = _rank(p, F.col("_n"))
            v = F.element_at("_all", (lower + 1).cast("int"))
            upper = F.coalesce(F.try_element_at("_all", (lower + 2).cast("int")), v)
            return v + (p * (F.col("_n") - 1).cast("double") - lower.cast("double")) * (upper - v)

        return _sorted_values(df, list(keys), value).select(*keys, F.transform(p_array, at).alias(name))

    def wanted(offset, size, total):
        return F.exists(p_array, lambda p: (_rank(p, total) >= offset) & (_rank(p, total) < offset + size))

    return quantiles_of(ranked_values(df, keys, value, wanted=wanted, largest=largest), list(keys), value, probs, name=name)


def quantile_table(df: DataFrame, keys, value: str, steps: int, name: str = "nodes", largest: int = LARGEST, cells: bool = False) -> DataFrame:
    """Per group the quantiles at 0, 1/steps, ..., 1 as an ascending array of steps + 1 nodes, plus ``n``.

    The node numbers a value covers follow from integer arithmetic, so the cost does not grow with steps. ``cells`` as in
    :func:`exact_quantiles`.
    """
    keys = list(keys)
    if cells and keys and small_groups(df.where(F.col(value).isNotNull()), keys, min(largest, SMALL)):
        every, step = F.sequence(F.lit(0).cast("bigint"), F.lit(steps).cast("bigint")), F.lit(steps).cast("bigint")

        def node(i):
            scaled = i * (F.col("_n") - 1)
            lower = _floor_div(scaled, step)
            v = F.element_at("_all", (lower + 1).cast("int"))
            upper = F.coalesce(F.try_element_at("_all", (lower + 2).cast("int")), v)
            return v + (scaled - lower * step).cast("double") / step.cast("double") * (upper - v)

        return _sorted_values(df, keys, value).select(*keys, F.transform(every, node).alias(name), F.col("_n").alias("n"))

    ranked = ranked_values(df, keys, value, largest=largest)
    m = F.lit(steps).cast("bigint")
    start, end, v = F.col("n_before"), F.col("n_before") + F.col("n"), F.col(value)
    span = (F.col("n_total") - 1).cast("bigint")
    # floor(i * span / m) lies in [start, end)  <=>  start * m <= i * span < end * m
    first = F.when(span == 0, F.lit(0)).otherwise(_ceil_div(start * m, span))
    last = F.when(span == 0, m).otherwise(_ceil_div(end * m, span) - 1)
    last = F.least(last, m)
    covered = ranked.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint"))
    covered = covered.where(F.col("_first") <= F.col("_last")).withColumn("_i", F.explode(F.sequence("_first", "_last")))
    scaled = F.col("_i") * span
    lower = _floor_div(scaled, m)
    fraction = (scaled - lower * m).cast("double") / m.cast("double")
    upper_value = F.when(lower + 1 < end, v).otherwise(F.coalesce(F.col("next_value"), v))
    q = v + fraction * (upper_value - v)
    rows = covered.select(*keys, "_i", q.alias("_q"), F.col("n_total"))
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda e: e["_q"]).alias(name),
        F.max("n_total").alias("n"),
    )


def two_samples(is_first: Column) -> dict[str, Column]:
    """Counters of the rows of two samples, for ``wasserstein_of``."""
    return {"a": F.when(is_first, 1).otherwise(0), "b": F.when(is_first, 0).otherwise(1)}


def wasserstein_of(ranked: DataFrame, keys, value: str, name: str = "wasserstein") -> DataFrame:
    """Wasserstein-1 distance per group between the samples that the counters ``a`` and ``b`` count."""
    fa = (F.col("a_before") + F.col("a")) / F.col("a_total")
    fb = (F.col("b_before") + F.col("b")) / F.col("b_total")
    step = F.coalesce(F.col("next_value") - F.col(value), F.lit(0.0))
    return ranked.where((F.col("a_total") > 0) & (F.col("b_total") > 0)).groupBy(*keys).agg(
        F.sum(F.abs(fa - fb) * step).alias(name)
    )


def wasserstein(df: DataFrame, keys, value: str, is_first: Column, name: str = "wasserstein", largest: int = LARGEST) -> DataFrame:
    """Wasserstein-1 distance between the rows where ``is_first`` holds and the others, per group."""
    return wasserstein_of(ranked_values(df, keys, value, weights=two_samples(is_first), largest=largest), keys, value, name)


def _as_array(rows: DataFrame, keys, name: str) -> DataFrame:
    # At most one entry per requested quantile, so the list is bounded by the request.
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda e: e["_q"]).alias(name)
    )


def _floor_div(a, b) -> Column:
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def _ceil_div(a, b) -> Column:
    return F.when(F.pmod(a, b) == 0, _floor_div(a, b)).otherwise(_floor_div(a, b) + 1)
