"""Inputs beyond the sizes that the small tables reach: nothing may be cut, lost or wrong."""

import datetime as dt
import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom import session
from gridloom.functions.columns import count_le
from gridloom.functions.gamma import LARGE_SHAPE, regularised_lower_gamma
from gridloom.functions.labels import variant_source
from gridloom.operators import biascorr, compare, distrib, geometry, regrid, samples, skill, timeops
from gridloom.plans import composites, standins
from gridloom.sources import archives, catalog
from gridloom.streaming import skill_stream


def test_nearest_in_time_reaches_any_distance(frame):
    day = dt.datetime(2000, 1, 1)
    field = frame([(day, 0, 0, 1.0), (day + dt.timedelta(days=400), 0, 0, 2.0), (day, 1, 0, 5.0), (day + dt.timedelta(hours=1), 0, 0, 1.5)], "time timestamp, iy int, ix int, value double")
    asks = [(day + dt.timedelta(days=d), y, 0) for d, y in ((150, 0), (200.0, 0), (300, 0), (9000, 0), (-5000, 0), (0, 0), (7000, 1), (3, 2))]
    got = {(r.at, r.iy): r.value for r in timeops.nearest_in_time(field, frame(asks, "at timestamp, iy int, ix int")).collect()}
    assert got == {(day + dt.timedelta(days=d), y): v for d, y, v in ((150, 0, 1.5), (200, 0, 1.5), (300, 0, 2.0), (9000, 0, 2.0), (-5000, 0, 1.0), (0, 0, 1.0), (7000, 1, 5.0))}
    tie = timeops.nearest_in_time(frame([(day, 0, 0, 1.0), (day + dt.timedelta(days=62), 0, 0, 2.0)], "time timestamp, iy int, ix int, value double"), frame([(day + dt.timedelta(days=31), 0, 0)], "at timestamp, iy int, ix int"))
    assert tie.first().value == 1.0  # of equal distances the earlier, across empty months


def test_nearest_cells_in_any_unit(frame):
    grid = frame([(0, k, 4000.0 * k, 0.0) for k in range(5)], "iy int, ix int, lon double, lat double")
    points = frame([(1, 100.0, 50.0), (2, 9000.0, 1e7), (3, -1e9, 0.0), (4, None, 0.0)], "point_id long, lon double, lat double")
    assert {(r.point_id, r.ix) for r in regrid.nearest_cells(points, grid, 30.0).collect()} == {(1, 0), (2, 2), (3, 0)}
    assert regrid.nearest_cells(points, grid.limit(0), 30.0).count() == 0


def test_stream_keeps_rows_however_late(spark, frame, tmp_path):
    ddl = "time timestamp, run string, a double, b double"
    source = str(tmp_path / "in")
    for k, year in enumerate((2001, 1995, 2010, 1995)):
        frame([(dt.datetime(year, 1, 1, k), "r", float(k), 0.0)] * (k + 1), ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    skill_stream.start_skill_stream(stream, str(tmp_path / "sums"), checkpoint=str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in skill_stream.latest_sums(spark, str(tmp_path / "sums")).collect()}
    want = {tuple(r) for r in skill_stream.difference_sums(spark.read.schema(ddl).parquet(source)).select("window_start", "run", "n", "sum_abs", "sum_sq", "max_abs").collect()}
    assert got == want and sum(r[2] for r in got) == 10


@pytest.mark.parametrize("shape,x,p", [
    (1e5, 1e5, 0.50042052), (1.0, 2.0, 1 - math.exp(-2)), (2.0, 30.0, 1 - 31 * math.exp(-30)), (1e8, 1e8, 0.5 + 1 / (3 * math.sqrt(2 * math.pi * 1e8))),
    (3e4, 3e4, 0.5 + 1 / (3 * math.sqrt(2 * math.pi * 3e4))), (5.0, 0.0, 0.0), (1e9, 1e9 * 1.1, 1.0), (1e9, 1e9 * 0.9, 0.0)])
def test_incomplete_gamma_of_any_shape(shape, x, p):
    assert regularised_lower_gamma(np.array([shape]), np.array([x]))[0] == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("x", [99_000.0, 99_500.0, 100_000.0, 100_700.0])
def test_incomplete_gamma_equals_the_poisson_tail(x):
    tail = sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(100_000, 104_000))
    assert regularised_lower_gamma(np.array([1e5, 1e5 * (1 + 1e-15)]), np.array([x, x])) == pytest.approx(tail, abs=1e-7)


def test_both_forms_of_the_incomplete_gamma_meet():
    x = LARGE_SHAPE * (1 + np.linspace(-0.02, 0.02, 41))
    below = regularised_lower_gamma(np.full(41, LARGE_SHAPE), x)
    above = regularised_lower_gamma(np.full(41, LARGE_SHAPE * (1 + 1e-12)), x)
    assert np.allclose(below, above, atol=1e-7)


def test_search_in_long_arrays(spark):
    row = spark.range(1).select(count_le(F.sequence(F.lit(0), F.lit(10_000)), F.lit(9_500), bits=14).alias("k")).first()
    assert row.k == 9_501
    with pytest.raises(PySparkException, match="more bits"):
        spark.range(1).select(count_le(F.sequence(F.lit(0), F.lit(10_000)), F.lit(9_500)).alias("k")).collect()


def test_transfer_tables_of_many_steps(spark):
    rows = spark.range(3000).selectExpr("element_at(array('train_hist', 'test_hist', 'test_future'), cast(id % 3 + 1 as int)) period", "timestamp'2000-01-01' + make_interval(0, 0, 0, cast(id div 3 as int)) time", "0 iy", "0 ix", "cast(id as double) * 1.5 obs", "cast(id as double) sim")
    got = biascorr.cdft(rows, steps=9000).where("period = 'train_hist' and corrected is not null")
    assert got.count() == 1000 and got.selectExpr("max(abs(corrected - obs))").first()[0] < 5


def test_strays_are_errors(frame):
    ddl = "time timestamp, role string, channel string, iy int, ix int, value float"
    day = dt.datetime(2000, 1, 1)
    for row in ((day, "x", "c", 0, 9, 1.0), (day, "x", "other", 0, 0, 1.0)):
        with pytest.raises(PySparkException, match="no place"):
            samples.pack(frame([row], ddl), ["c"], 2, 2).collect()
        with pytest.raises(PySparkException, match="no place"):
            archives.encode_archives(frame([row], ddl), ["c"], 2, 2).collect()
    with pytest.raises(PySparkException, match="outside"):
        geometry.pad(frame([(day, 0, 2, 1.0)], "time timestamp, iy int, ix int, value double"), 2, 2, 0.0).collect()


def test_template_covers_the_grid(frame):
    grid = frame([(y, x) for y in range(12) for x in range(3) if (y, x) != (4, 1)], "iy int, ix int")
    times = frame([(dt.datetime(2000, 1, d),) for d in (1, 2, 2)], "time timestamp")
    got = samples.prediction_template(times, grid)
    assert got.count() == 2 * 35 and got.where("iy = 4 and ix = 1 or value is not null").count() == 0


@pytest.mark.parametrize("values", [[3.0] * 4, [1.0, 1.0, 2.0]])
def test_histogram_equals_numpy(frame, values):
    got = {r.bin: (r.n, r.density) for r in distrib.histogram(frame([(1, v) for v in values], "k int, value double"), ["k"], 10).collect()}
    counts, edges = np.histogram(values, 10)
    density, _ = np.histogram(values, 10, density=True)
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in enumerate(counts) if n}
    assert all(d == pytest.approx(density[k]) for k, (_, d) in got.items())


@pytest.mark.parametrize("shape", [0.05, 0.5, 2.0, 30.0, 2000.0])
def test_newton_steps_suffice_for_any_shape(frame, shape):
    values = np.random.default_rng(1).gamma(shape, 3.0, 4000)
    values = values[values > 1e-12] + 0.0
    a = biascorr.gamma_fit(frame([(0, float(v)) for v in values], "k int, value double"), ["k"], threshold=0.0).first().alpha
    slope = math.log(a) - (math.lgamma(a * (1 + 1e-6)) - math.lgamma(a * (1 - 1e-6))) / (2e-6 * a) - (math.log(values.mean()) - np.log(values).mean())
    assert abs(slope) < 1e-4 * max(1.0, 1 / a)


def test_unknown_sources_are_errors(frame):
    names = frame([("model_a",), ("gcm_bc",), (None,), ("nobody",)], "v string")
    known = names.where("v is null or v <> 'nobody'").select(variant_source("v", {"gcm": "model_a"}, ["model_a"]).alias("s"))
    assert [r.s for r in known.collect()] == ["model_a", "model_a", None]
    with pytest.raises(PySparkException, match="nobody"):
        names.select(variant_source("v", {"gcm": "model_a"}, ["model_a"])).collect()
    assert names.select(variant_source("v", {"gcm": "model_a"}, ["model_a"], unknown="null").alias("s")).where("s is null").count() == 2


def test_wide_rows_are_not_broadcast(spark):
    assert session.fits_broadcast(spark.range(1000))
    assert not session.fits_broadcast(spark.range(1000).selectExpr("id", "sequence(1, 5000) as nodes"))


def test_scratch_removes_what_is_not_kept(spark):
    with session.scratch() as outer:
        with session.scratch() as block:
            gone, kept = session.materialise(spark.range(3), "gone"), session.materialise(spark.range(4), "kept")
            block.keep(kept)
        path = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 4 and os.path.isdir(path(kept))
        with pytest.raises(Exception, match="(?i)does not exist|not found"):
            gone.collect()
        where = path(kept)
        assert len(outer.written) == 1
    assert not os.path.exists(where)
    outside = session.materialise(spark.range(5), "outside")
    with pytest.raises(ZeroDivisionError), session.scratch():
        session.materialise(spark.range(2), "x")
        1 / 0
    assert outside.count() == 5


def test_settings_are_restored(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with session.arrow_batches(spark, rows=7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before


def counted_pairs(spark):
    """Pairs of two methods, and a counter of the rows that were made for those who read them."""
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return ("ab"[i % 2], dt.datetime(2000 + i // 600, 1 + i // 50 % 12, 1 + i // 4 % 12), i // 2 % 2, 0, float(i % 17), float(i % 13))

    rows = spark.sparkContext.parallelize(range(1800), 2).map(row)
    return made, spark.createDataFrame(rows, "method string, time timestamp, iy int, ix int, obs double, pred double")


def test_comparisons_make_their_pairs_once(spark):
    made, pairs = counted_pairs(spark)
    parts = composites.model_evaluation(pairs, [("w", "2000-01-01", "2002-12-31")], ("2000-01-01", "2000-12-31"), ("2002-01-01", "2002-12-31"))
    assert all(p.count() for p in parts.values()) and made.value == 1800
    made, pairs = counted_pairs(spark)
    assert compare.comparison_suite(pairs, density_range=(0.0, 20.0), bins=4).count() and made.value == 1800


def test_points_of_a_year_lie_together_in_order(spark, tmp_path):
    """The comparison's points: the days as they are, a cell's year in one partition; rows without a date or a cell too."""
    rows = [(k, k % 3, None if k % 97 == 0 else k % 17, "R" if k % 5 == 0 else "N", "O", float(k % 50), 1.0, 0.01 * (k % 8), 0.01 * (k % 11),
             None if k % 89 == 0 else dt.datetime(1995 + k % 4, 1 + k % 12, 1 + k % 27), k) for k in range(3000)]
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_shipdate timestamp_ntz, l_partkey long"
    spark.createDataFrame(rows, names).repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain, ordered = (f(spark, str(tmp_path)) for f in (standins.daily_points, standins.ordered_points))
    told = lambda t: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()], key=str)
    assert ordered.columns == plain.columns and told(ordered) == told(plain)
    with session.settings(spark, spark__sql__adaptive__enabled=False):
        parts = standins.ordered_points(spark, str(tmp_path)).select("*", F.spark_partition_id().alias("p"), F.year("time").alias("year"))
        assert parts.groupBy("iy", "ix", "year").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
        kept = [[(r.iy or -1, r.ix if r.ix is not None else -1, str(r.time or "")) for r in rows] for rows in parts.rdd.glom().collect()]
        assert sum(len(k) > 1 for k in kept) > 1 and all(k == sorted(k) for k in kept)


def test_months_are_carried_over_the_borders_of_years_only(spark, monkeypatch):
    """The same increments as by buckets of months, in which every month would be a border."""
    rows = [(dt.datetime(2000 + m // 12, 1 + m % 12, 1 + d), 0, x, float((m * 7 + d + x) % 11), float((m * 5 + d) % 13)) for m in range(40) for d in (0, 9) for x in (0, 1) if m % 9 != 4]
    pairs = spark.createDataFrame(rows, "time timestamp, iy int, ix int, obs double, pred double")
    used, previous_row = [], skill.previous_row
    monkeypatch.setattr(skill, "previous_row", lambda df, keys, time, columns, unit="month", *a: (used.append(unit), previous_row(df, keys, time, columns, unit, *a))[1])
    got = sorted(map(tuple, skill.monthly_skill_summary(pairs).collect()))
    want = sorted(map(tuple, skill.skill_summary(skill.monthly_pairs(pairs)).collect()))
    assert used == ["year", "month"]
    assert [g[0] for g in got] == [w[0] for w in want] == ["all", "summer", "winter"]
    assert all(a == b or a == pytest.approx(b, rel=1e-12) for g, w in zip(got, want) for a, b in zip(g[1:], w[1:]))


@pytest.mark.parametrize("limits", [{}, {"BLOCK_WEIGHTS": 5, "TASK_ROWS": 20}, {"DENSE_ROWS": 2}])
def test_samples_on_the_target_grid_are_not_shuffled_again(spark, monkeypatch, limits):
    """Dealt by block or not, broadcast or not, the same rows; with null and strange cells, repeated targets and times without one."""
    for name, value in limits.items():
        monkeypatch.setattr(regrid, name, value)
    cells = [(y, x) for y in range(6) for x in range(4)]
    first = spark.createDataFrame([(y, x, y // 3, x // 2, 1 / 6) for y, x in cells], "src_iy int, src_ix int, dst_iy int, dst_ix int, w double")
    second = spark.createDataFrame([(m, n, y, x, w) for y, x in cells for m, n, w in [(y // 3, x // 2, 0.75), (1 - y // 3, x // 2, 0.25)]], "src_iy int, src_ix int, dst_iy int, dst_ix int, w double")
    rows = [(dt.datetime(2000, 1, 1 + t), y, x, float(t * 7 + y * 3 + x) if (t + y) % 3 else None) for t in range(5) for y, x in cells if (t * y + x) % 4]
    rows += [(None, 1, 1, 5.0), (dt.datetime(2000, 1, 2), None, 1, 6.0)]
    field = spark.createDataFrame(rows, "time timestamp, iy int, ix int, value double")
    target = spark.createDataFrame([r for r in rows if r[0] is None or r[0].day != 3] + rows[:3] + [(dt.datetime(2000, 1, 1), 77, 0, 1.0)], "time timestamp, iy bigint, ix bigint, value double")
    static = spark.createDataFrame([(y, x, y * 10.0 + x) for y, x in cells[3:]], "iy int, ix int, value double")
    chain = regrid.chain_weights(first, second)
    built = composites.training_samples(target, static, {"a": field, "b": field.withColumn("value", F.col("value") * 2)}, chain)
    plain = composites.training_samples(target, static, {"a": field, "b": field.withColumn("value", F.col("value") * 2)}, chain.pairs())
    assert built.columns == plain.columns
    got, want = (sorted((tuple(str(v) for v in r[:5]) + (r.value is None, round(r.value or 0, 3)) for r in t.collect()), key=str) for t in (built, plain))
    assert got == want and len(got) > 300 and sum(not r[5] for r in got) > 50
    if "DENSE_ROWS" not in limits:
        target = target.withColumns({c: F.col(c).cast("int") for c in ("iy", "ix")})
        plan = composites.training_samples(target, static, {"a": field}, chain)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("Window") : plan.index("Union")]


def test_a_field_is_written_in_time_order_without_a_sort_by_partition(spark, tmp_path):
    days = spark.range(400, numPartitions=1).selectExpr("timestamp_ntz'1999-06-01' + make_dt_interval(cast(399 - id as int)) as time")
    both = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source")
    field = days.select(both, F.lit("tas").alias("variable"), F.lit("historical").alias("scenario"), F.lit("r1").alias("member"), "time", F.lit(0).alias("iy"), F.lit(0).alias("ix"), F.lit(1.0).alias("value"))
    catalog.write_field(field, f"{tmp_path}/sorted")
    catalog.write_field(field.sortWithinPartitions("time"), f"{tmp_path}/given", in_order=True)
    for root in ("sorted", "given"):
        files = sorted((tmp_path / root).rglob("*.parquet"))
        assert len(files) == 4 and sum(len(pq.read_table(f, partitioning=None)) for f in files) == 800
        assert all(pq.read_table(f, partitioning=None)["time"].to_pandas().is_monotonic_increasing for f in files)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
