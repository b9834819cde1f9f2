import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import labels as L
from gridloom.operators import align, geometry, masks, normalise, regrid, skill

AXIS = "lon double"


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def grid_of(frame, lons, lats):
    return frame([(j, i, float(lon), float(lat)) for j, lat in enumerate(lats) for i, lon in enumerate(lons)], "iy int, ix int, lon double, lat double")


def test_masked_metrics(frame):
    r = skill.masked_errors(frame([(2.0, 1.0), (4.0, 2.0)], "pred double, y double"), ignore=-999.0).first()
    assert r.rmse == pytest.approx(2.5**0.5, abs=1e-7) and r.mae == pytest.approx(1.5) and r.loss == pytest.approx(2.5**0.5)


def test_ignored_value_is_left_out(frame):
    r = skill.masked_errors(frame([(2.0, 1.0), (4.0, 2.0), (5.0, -999.0)], "pred double, y double"), ignore=-999.0).first()
    assert r.mae == pytest.approx(1.5)


def test_standard_and_minmax(frame):
    stats = frame([("chan1", 10.0, 2.0, 0.0, 10.0), ("chan2", 5.0, 1.0, 0.0, 10.0)], "channel string, mean double, std double, min double, max double")
    rows = frame([("x", "chan1", 12.0), ("x", "chan1", 8.0), ("x", "chan2", 6.0), ("x", "chan2", 4.0), ("y", "t", 3.0)], "role string, channel string, value double")
    got = sorted(values(normalise.standardise(rows, stats), "role", "channel", "value"))
    assert got == [("x", "chan1", -1.0), ("x", "chan1", 1.0), ("x", "chan2", -1.0), ("x", "chan2", 1.0), ("y", "t", 3.0)]
    half = frame([("x", "chan1", 5.0), ("y", "t", 5.0)], "role string, channel string, value double")
    assert values(normalise.minmax(half, stats, "chan1"), "value") == [0.5, 0.5]
    assert sorted(values(normalise.minmax(half, stats, "chan1", output_norm=False), "value")) == [0.5, 5.0]
    out = normalise.inverse_minmax(frame([(2.0,), (-1.0,), (0.0,)], "value double"), stats, "chan1", "minus_one_one")
    assert sorted(values(out, "value")) == [0.0, 5.0, 10.0]


def test_pad_and_unpad(frame):
    ones = frame([(1, j, i, 1.0) for j in range(10) for i in range(10)], "time int, iy int, ix int, value double")
    padded = geometry.pad(ones, 10, 10, -999.0)
    assert padded.count() == 32 * 32
    assert padded.where("iy = 0 and ix = 0").first().value == -999.0
    back = geometry.unpad(padded, 10, 10)
    assert back.count() == 100 and set(values(back, "value")) == {1.0} and max(values(back, "iy")) == 9


def test_log_channel(frame):
    rows = frame([("elevation", 10.0), ("pr input", 9.0)], "channel string, value double")
    assert sorted(values(normalise.log_precipitation(rows), "value")) == [1.0, 10.0]


def test_wind(frame):
    w = frame([(3.0, 4.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)], "u double, v double")
    assert w.select(C.wind_speed("u", "v")).first()[0] == 5.0
    assert [round(d, 6) for d in values(w.select(C.wind_from_direction("u", "v").alias("d")), "d")[1:]] == [270, 180, 90, 0]


def test_misaligned_components(frame):
    u = frame([(0, 0, 1.0), (0, 1, 1.0)], "time int, x int, uas double")
    v = frame([(0, 0, 1.0), (0, 2, 1.0)], "time int, x int, vas double")
    with pytest.raises(ValueError, match="x="):
        align.join_components(u, v, ("time", "x"))


def test_longitudes_and_bounds(frame):
    grid = frame([("g", 0, 0, 350.0, 1.0), ("g", 0, 1, 10.0, 1.0)], "grid_id string, iy int, ix int, lon double, lat double")
    assert sorted(values(geometry.wrap_grid(grid), "ix", "lon")) == [(0, -10.0), (1, 10.0)]
    axis = geometry.axis_bounds(frame([(10.0,), (20.0,), (30.0,)], AXIS), "lon").orderBy("lon")
    assert values(axis, "lo", "hi") == [(5.0, 15.0), (15.0, 25.0), (25.0, 35.0)]


def test_crops(frame):
    rect = grid_of(frame, [0, 10, 20], [0, 10, 20])
    assert values(geometry.crop(rect, (5, 15, 5, 15)), "lon", "lat") == [(10.0, 10.0)]
    assert geometry.crop(rect, (10, 20, 0, 10)).count() == 4  # edges included
    curv = frame([(0, 0, 0.0, 40.0), (0, 1, 10.0, 50.0), (0, 2, 20.0, 40.0), (1, 0, 0.0, 60.0), (1, 1, 12.0, 60.0), (1, 2, 20.0, 60.0)], "iy int, ix int, lon double, lat double")
    field = curv.select("iy", "ix", F.lit(1.0).alias("value"))
    out = geometry.crop_curvilinear(field, curv, (5, 15, 45, 55))
    assert values(out, "lon", "value") == [(10.0, 1.0)]


def test_mask_join(frame):
    field = frame([(45.0, 3.0, 1.0), (45.0, 4.0, 2.0), (46.0, 3.0, 3.0), (46.0, 4.0, 4.0)], "lat double, lon double, value double")
    mask = frame([(45.0, 3.0, 1.0), (45.0, 4.0, 0.0), (46.0, 3.0, 0.0)], "lat double, lon double, mask_value double")
    got = {(r.lat, r.lon): (r.value, r.mask) for r in masks.land_sea_mask(field, mask, "eobs", ("lat", "lon")).collect()}
    assert got[(45.0, 3.0)] == (None, 0) and got[(45.0, 4.0)] == (2.0, 1) and got[(46.0, 4.0)] == (4.0, 1)
    with pytest.raises(ValueError):
        masks.land_sea_mask(field, mask, "moon", ("lat", "lon"))


def test_units(frame):
    rows = [("s", "tas", "gcm", 1, 20.0), ("s", "tas", "gcm", 1, None), ("s", "tas", "gcm", 2, 290.0), ("s", "pr", "gcm", 1, -1.0), ("s", "pr", "gcm", 1, 1e-5), ("s", "pr", "eobs", 1, 3.0)]
    df = frame(rows, "source string, variable string, data_type string, time int, value double")
    got = sorted((v, t, round(x, 6)) for v, t, x in values(masks.clean_units(df).where("value is not null"), "variable", "time", "value"))
    assert got == [("pr", 1, 0.0), ("pr", 1, 0.864), ("pr", 1, 3.0), ("tas", 1, 293.15), ("tas", 2, 290.0)]
    with pytest.raises(Exception, match="no unit"):
        df.select(L.unit_of(F.lit("zz"))).collect()


def test_region_mask_follows_weights(frame):
    field = frame([(0, 0, 1.0), (0, 1, 2.0)], "iy int, ix int, value double")
    region = frame([(0, 0, 41), (0, 1, 41), (0, 2, 41), (0, 3, 1)], "iy int, ix int, region int")
    weights = frame([(0, 0, 0, 0, 0.5), (0, 1, 0, 0, 0.5), (0, 2, 0, 1, 0.5), (0, 3, 0, 1, 0.5)], "src_iy int, src_ix int, dst_iy int, dst_ix int, w double")
    assert sorted(values(masks.null_regions(field, region, weights=weights), "ix", "value")) == [(0, None), (1, 2.0)]


def test_regrid_keeps_constants_and_nulls(frame):
    src, dst = grid_of(frame, [0, 1, 2, 3], [0, 1, 2, 3]), grid_of(frame, [0.5, 2.5], [0.5, 2.5])
    for weights in (regrid.conservative_weights(src, dst), regrid.bilinear_weights(src, dst)):
        sums = weights.groupBy("dst_iy", "dst_ix").agg(F.sum("w").alias("s"))
        assert sums.count() == 4 and all(abs(s - 1) < 1e-12 for s in values(sums, "s"))
        field = src.select(F.lit(1).alias("time"), "iy", "ix", F.when((F.col("iy") == 0) & (F.col("ix") == 0), None).otherwise(7.0).alias("value"))
        strict = {(y, x): v for y, x, v in values(regrid.regrid(field, weights), "iy", "ix", "value")}
        assert strict[(0, 0)] is None and strict[(1, 1)] == pytest.approx(7.0)
        assert all(v == pytest.approx(7.0) for v in values(regrid.regrid(field, weights, renormalise=True), "value"))


def test_conservative_area_integral(frame):
    import math
    lats = [0, 10, 20, 30]
    src, dst = grid_of(frame, [0, 10, 20, 30], lats), grid_of(frame, [5, 25], [5, 25])
    field = src.select(F.lit(1).alias("time"), "iy", "ix", (F.col("lon") * 2 + F.col("lat")).alias("value"))
    area = lambda lat, h: math.sin(math.radians(lat + h)) - math.sin(math.radians(lat - h))
    before = sum((2 * lon + lat) * 10 * area(lat, 5) for lat in lats for lon in (0, 10, 20, 30))
    out = {(y, x): v for y, x, v in values(regrid.regrid(field, regrid.conservative_weights(src, dst)), "iy", "ix", "value")}
    after = sum(out[(j, i)] * 20 * area(lat, 10) for j, lat in enumerate((5, 25)) for i in range(2))
    assert after == pytest.approx(before)


def test_bilinear_nearest_outside(frame):
    src, dst = grid_of(frame, [0, 10], [0, 10]), grid_of(frame, [-5, 5, 20], [5, 15])
    field = src.select(F.lit(1).alias("time"), "iy", "ix", F.col("lon").alias("value"))
    out = sorted(values(regrid.regrid(field, regrid.bilinear_weights(src, dst)), "iy", "ix", "value"))
    assert out == [(0, 0, 0.0), (0, 1, 5.0), (0, 2, 10.0), (1, 0, 0.0), (1, 1, 5.0), (1, 2, 10.0)]


def test_chained_weights_equal_two_regrids(frame):
    fine, mid, out = grid_of(frame, range(6), range(6)), grid_of(frame, [1, 4], [1, 4]), grid_of(frame, [1.5, 2.5, 3.5], [1.5, 3])
    w1, w2 = regrid.conservative_weights(fine, mid), regrid.bilinear_weights(mid, out)
    field = fine.select(F.lit(1).alias("time"), "iy", "ix", (F.col("lon") * F.col("lat")).alias("value"))
    once = sorted(values(regrid.regrid(field, regrid.chain_weights(w1, w2)), "iy", "ix", "value"))
    twice = sorted(values(regrid.regrid(regrid.regrid(field, w1), w2), "iy", "ix", "value"))
    assert [r[2] for r in once] == pytest.approx([r[2] for r in twice])


def test_chain_keeps_two_tables_and_agrees_with_all_pairs(frame):
    fine, mid = grid_of(frame, range(12), range(9)), grid_of(frame, [2, 5.5, 9], [2, 6])
    chain = regrid.chain_weights(regrid.conservative_weights(fine, mid), regrid.conservative_weights(mid, fine))
    pairs = chain.pairs()
    want = sorted(values(pairs.groupBy("dst_iy", "dst_ix").agg(F.sum("w").alias("total"), F.count("w").alias("n")), "dst_iy", "dst_ix", "total", "n"))
    got = sorted(values(chain.per_target(), "dst_iy", "dst_ix", "total", "n"))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    # Far fewer rows than pairs.
    assert chain.first.count() + chain.second.count() < pairs.count() / 5
    # Gaps, a cell that is missing, one that stands twice, and a time without values.
    field = fine.select("iy", "ix", F.explode(F.array(F.lit(1), F.lit(2))).alias("time"), F.when((F.col("iy") + F.col("ix")) % 3 != 0, F.col("lon") * F.col("lat") + 1).alias("value"))
    field = field.withColumn("value", F.when(F.col("time") == 1, F.col("value"))).where("iy <> 4 or ix <> 4").unionByName(field.where("iy = 2 and ix = 3"))
    for renormalise in (True, False):
        both = [sorted(values(regrid.regrid(field, w, renormalise=renormalise), "time", "iy", "ix", "value"), key=str) for w in (chain, pairs)]
        assert [r[:3] for r in both[0]] == [r[:3] for r in both[1]]
        if renormalise:
            assert [r[3] is None for r in both[0]] == [r[3] is None for r in both[1]]
            assert [r[3] or 0.0 for r in both[0]] == pytest.approx([r[3] or 0.0 for r in both[1]])


def test_nearest_reaches_far_points_and_last_wins(frame):
    grid = grid_of(frame, [0, 1], [0, 1])
    points = frame([(1, 0.1, 0.1), (2, 0.2, 0.2), (3, 60.0, 50.0)], "point_id int, lon double, lat double")
    cells = regrid.nearest_cells(points, grid, 0.5)
    assert sorted(values(cells, "point_id", "iy", "ix")) == [(1, 0, 0), (2, 0, 0), (3, 1, 1)]
    vals = frame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "time int, point_id int, value double")
    assert sorted(values(regrid.scatter_points(vals, cells), "iy", "value")) == [(0, 20.0), (1, 30.0)]
