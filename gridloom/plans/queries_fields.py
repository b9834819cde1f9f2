"""Geometry, masks, units, time selection and scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import labels as L
from gridloom.operators import geometry, masks, regrid, timeops
from gridloom.plans import standins as S
from gridloom.plans.registry import query

DOMAIN = (-120.0, 120.0, 5.0, 30.0)


@query("iy:i ix:i lon:f", "B1", """
    SELECT g.iy, CAST(a.k - 1 AS INTEGER) AS ix, a.lon FROM
    (SELECT iy, ((lon + 180) % 360) - 180 AS lon FROM grid_cells) g JOIN
    (SELECT lon, row_number() OVER (ORDER BY lon) AS k FROM (SELECT DISTINCT ((lon + 180) % 360) - 180 AS lon FROM grid_cells)) a USING (lon)""")
def longitude_wrap(spark, sf):
    return geometry.wrap_grid(S.grid(spark, sf))


@query("x:i y:i lon:f lat:f", "B2", "SELECT ix AS x, iy AS y, lon, lat FROM grid_cells")
def coordinate_names(spark, sf):
    odd = S.grid(spark, sf).select(F.col("ix").alias("nlon"), F.col("iy").alias("nlat"), F.col("lon").alias("nav_lon"), F.col("lat").alias("latitude"))
    return geometry.standard_coordinates(odd)


@query("iy:i ix:i lat:f", "B3", "SELECT (SELECT max(iy) FROM grid_cells) - iy AS iy, ix, lat FROM grid_cells")
def latitude_flip(spark, sf):
    grid = S.grid(spark, sf)
    rows = grid.agg(F.max("iy").alias("m")).first().m + 1
    return geometry.flip_latitude(grid, rows)


@query("time:d iy:i ix:i value:f", "B4", f"""
    SELECT time, iy, ix, obs AS value FROM daily_points JOIN
    (SELECT iy, ix, ((lon + 180) % 360) - 180 AS lon, lat FROM grid_cells) USING (iy, ix)
    WHERE lon BETWEEN {DOMAIN[0]} AND {DOMAIN[1]} AND lat BETWEEN {DOMAIN[2]} AND {DOMAIN[3]}""")
def domain_crop(spark, sf):
    grid = S.grid(spark, sf).withColumn("lon", C.wrap_longitude("lon"))
    kept = geometry.crop(grid, DOMAIN).select("iy", "ix")
    return S.observed(spark, sf).join(kept, ["iy", "ix"])


@query("time:d iy:i ix:i value:f", "B4", """
    WITH skew AS (SELECT iy, ix, lon + lat AS lon, lat + ix * 0.5 AS lat FROM grid_cells),
    kept AS (SELECT *, lon BETWEEN 60 AND 200 AND lat BETWEEN 10 AND 25 AS inside FROM skew
      WHERE ix IN (SELECT ix FROM skew WHERE lon BETWEEN 60 AND 200) AND iy IN (SELECT iy FROM skew WHERE lat BETWEEN 10 AND 25))
    SELECT time, iy, ix, CASE WHEN inside THEN obs END AS value FROM daily_points JOIN kept USING (iy, ix)""")
def curvilinear_crop(spark, sf):
    g = S.grid(spark, sf)
    skew = g.withColumns({"lon": F.col("lon") + F.col("lat"), "lat": F.col("lat") + F.col("ix") * 0.5})
    return geometry.crop_curvilinear(S.observed(spark, sf), skew, (60.0, 200.0, 10.0, 25.0))


@query("iy:i ix:i", "B5", "SELECT iy, ix FROM grid_cells WHERE lon BETWEEN 99.5 AND 200.5 AND lat BETWEEN 9.5 AND 20.5")
def padded_crop(spark, sf):
    return geometry.crop(S.grid(spark, sf), (100.0, 200.0, 10.0, 20.0), margin=0.5)


@query("time:d iy:i ix:i value:f mask:i", "B6", """
    SELECT time, iy, ix, CASE WHEN height < 0 THEN NULL ELSE obs END AS value, CASE WHEN height < 0 OR obs IS NULL THEN 0 ELSE 1 END AS mask
    FROM daily_points LEFT JOIN grid_cells USING (iy, ix)""")
def land_sea_mask(spark, sf):
    mask = S.grid(spark, sf).select("iy", "ix", (F.col("height") >= 0).cast("double").alias("mask_value"))
    return masks.land_sea_mask(S.observed(spark, sf), mask, "era5")


@query("time:d channel:s iy:i ix:i value:f", "B8", """
    SELECT time, 'ml input' AS channel, iy, ix, CASE WHEN obs IS NOT NULL THEN ml END AS value FROM daily_points
    UNION ALL SELECT time, 'raw input', iy, ix, CASE WHEN obs IS NOT NULL THEN raw END FROM daily_points""")
def footprint_mask(spark, sf):
    p = S.daily_points(spark, sf)
    each = F.explode(F.array(
        F.struct(F.lit("x").alias("role"), F.lit("raw input").alias("channel"), F.col("raw").alias("value")),
        F.struct(F.lit("x").alias("role"), F.lit("ml input").alias("channel"), F.col("ml").alias("value")),
        F.struct(F.lit("y").alias("role"), F.lit("target").alias("channel"), F.col("obs").alias("value")))).alias("c")
    samples = p.select("time", "iy", "ix", each).select("time", "iy", "ix", "c.*")
    return masks.footprint_mask(samples, "raw input").where("role = 'x'")


@query("source:s variable:s time:d iy:i ix:i value:f", "B9", """
    WITH f AS (SELECT 'model' AS source, 'pr' AS variable, time, iy, ix, (raw - 20) / 86400 AS value FROM daily_points
      UNION ALL SELECT 'model', 'tas', time, iy, ix, raw FROM daily_points UNION ALL SELECT 'station', 'tas', time, iy, ix, obs + 250 FROM daily_points),
    m AS (SELECT source, time, avg(value) AS m FROM f WHERE variable = 'tas' GROUP BY 1, 2)
    SELECT source, variable, time, iy, ix, CASE WHEN value IS NULL THEN NULL WHEN variable = 'pr' THEN greatest(value, 0) * 86400
      WHEN m < 100 THEN value + 273.15 ELSE value END AS value FROM f LEFT JOIN m USING (source, time)""")
def unit_cleaning(spark, sf):
    p = S.daily_points(spark, sf)

    def part(source, variable, kind, value):
        return p.select(F.lit(source).alias("source"), F.lit(variable).alias("variable"), F.lit(kind).alias("data_type"), "time", "iy", "ix", value.alias("value"))

    field = part("model", "pr", "gcm", (F.col("raw") - 20) / 86400).unionByName(part("model", "tas", "gcm", F.col("raw"))).unionByName(
        part("station", "tas", "eobs", F.col("obs") + 250))
    return masks.clean_units(field)


@query("time:d iy:i ix:i value:f", "B10", "SELECT time, iy, ix, obs AS value FROM daily_points WHERE time >= '1997-03-01' AND time < '1999-02-11'")
def date_window(spark, sf):
    return timeops.filter_dates(S.observed(spark, sf), "1997-03-01", "1999-02-10")


@query("at:t iy:i ix:i time:t value:f", "B11", """
    WITH want AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOUR AS "at" FROM events UNION SELECT ts FROM events WHERE event_id = 100)
    SELECT "at", iy, ix, arg_min(e.time, (e.time <> "at", e.time)) AS time, arg_min(value, (e.time <> "at", e.time)) AS value
    FROM want JOIN event_points e ON date_trunc('day', e.time) = date_trunc('day', "at") GROUP BY 1, 2, 3""")
def exact_or_same_day(spark, sf):
    e = S.event_points(spark, sf)
    noon = e.select((F.date_trunc("day", "time") + F.expr("INTERVAL '12' HOUR")).cast("timestamp_ntz").alias("at")).distinct()
    exact = e.where("event_id = 100").select(F.col("time").alias("at"))
    return timeops.select_times(e, noon.union(exact).distinct())


@query("time:t iy:i ix:i event_id:l value:f", "B12", """
    SELECT time, iy, ix, event_id, value FROM event_points WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 23:59:59'""")
def batch_window(spark, sf):
    return timeops.batch_window(S.event_points(spark, sf), "2024-01-05", "2024-01-12", "daily", "daily")


@query("time:t event_id:l", "B12", """
    SELECT time, event_id FROM event_points WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 05:00:00'""")
def batch_window_hours(spark, sf):
    return timeops.batch_window(S.event_points(spark, sf), "2024-01-05", "2024-01-12", "hourly", "6h")


@query("time:d iy:i ix:i value:f", "B13", """
    SELECT time, iy, ix, obs AS value FROM daily_points WHERE time >= '1996-01-01' AND date_diff('day', DATE '1996-01-01', time::DATE) % 7 = 0""")
def weekly_stride(spark, sf):
    return timeops.every_n_days(S.observed(spark, sf), "1996-01-01", 7)


@query("time:d iy:i ix:i value:f", "B14", """
    SELECT time, iy, ix, obs AS value FROM daily_points WHERE time BETWEEN TIMESTAMP '1995-02-01' AND TIMESTAMP '2001-06-30' AND
    (date_diff('day', DATE '1995-02-01', time::DATE) % 365 = 0 OR strftime(time, '%m%d') IN ('0115', '0715', '1231'))""")
def calendar_sample(spark, sf):
    return timeops.calendar_sample(S.observed(spark, sf), "1995-02-01", "2001-06-30")


@query("n_pairs:l n_rows:l", "B15", "SELECT count(*) FILTER (obs IS NOT NULL AND raw IS NOT NULL) AS n_pairs, count(*) AS n_rows FROM daily_points")
def finite_pairs(spark, sf):
    p = S.line_rows(spark, sf).groupBy("time", "iy", "ix").agg(F.avg(F.coalesce("obs", F.lit(float("nan")))).alias("o"), F.avg("obs").alias("obs"), F.avg("raw").alias("raw"))
    # A NaN-coded series is brought to NULL first; the mean of a day holding a NaN is NaN, so the NULL-coded one is used.
    return p.agg(F.count_if(C.finite("obs").isNotNull() & C.finite("raw").isNotNull()).alias("n_pairs"), F.count(F.lit(1)).alias("n_rows"))


@query("vec_id:l value:f", "B16", "SELECT vec_id, value FROM channel_values WHERE pos = 5")
def channel_select(spark, sf):
    return S.channel_values(spark, sf).where(F.col("pos") == 5)


@query("window:s n:l mean:f", "B17", " UNION ALL ".join(
    f"SELECT '{w}' AS \"window\", count(obs) AS n, avg(obs) AS mean FROM daily_points WHERE time::DATE BETWEEN '{a}' AND '{b}'" for w, a, b in S.WINDOWS))
def named_windows(spark, sf):
    return timeops.tag_windows(S.daily_points(spark, sf), S.WINDOWS).groupBy("window").agg(F.count("obs").alias("n"), F.avg("obs").alias("mean"))


@query("window:s n:l mean:f", "B17", """
    WITH w AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || o_orderpriority AS "window", min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)
    SELECT "window", count(obs) AS n, avg(obs) AS mean FROM w JOIN daily_points ON time::DATE BETWEEN a AND b GROUP BY 1""")
def windows_from_table(spark, sf):
    name = F.concat(F.year("o_orderdate").cast("string"), F.col("o_orderpriority"))
    windows = S.table(spark, sf, "orders").groupBy(name.alias("window")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return timeops.tag_windows_table(S.daily_points(spark, sf), windows).groupBy("window").agg(F.count("obs").alias("n"), F.avg("obs").alias("mean"))


@query("season:s half:s n:l mean:f", "B18", """
    SELECT CASE WHEN month(time) IN (6, 7, 8) THEN 'summer' WHEN month(time) IN (12, 1, 2) THEN 'winter' END AS season,
    CASE WHEN month(time) BETWEEN 3 AND 8 THEN 'MAMJJA' ELSE 'SONDJF' END AS half, count(obs) AS n, avg(obs) AS mean FROM daily_points GROUP BY 1, 2""")
def season_tags(spark, sf):
    p = S.daily_points(spark, sf)
    return p.groupBy(timeops.season("time").alias("season"), timeops.half_year("time").alias("half")).agg(F.count("obs").alias("n"), F.avg("obs").alias("mean"))


@query("time:d iy:i ix:i value:f", "B19", """
    SELECT t.time, CAST(a.i AS INTEGER) AS iy, CAST(b.i AS INTEGER) AS ix, CASE WHEN p.iy IS NULL THEN -999.0 ELSE p.raw END AS value
    FROM (SELECT DISTINCT date_trunc('month', time)::TIMESTAMP AS time FROM tile_points) t, range(32) a(i), range(32) b(i)
    LEFT JOIN (SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(raw) AS raw FROM tile_points GROUP BY 1, 2, 3) p
    ON p.time = t.time AND p.iy + 11 = a.i AND p.ix + 11 = b.i""")
def pad_grid(spark, sf):
    field = timeops.monthly_mean(S.tile_points(spark, sf), values=("raw",)).withColumnRenamed("raw", "value")
    return geometry.pad(field, S.NY, S.NX, -999.0)


@query("time:d iy:i ix:i value:f", "B19", "SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(raw) AS value FROM tile_points GROUP BY 1, 2, 3")
def pad_and_unpad(spark, sf):
    field = timeops.monthly_mean(S.tile_points(spark, sf), values=("raw",)).withColumnRenamed("raw", "value")
    return geometry.unpad(geometry.pad(field, S.NY, S.NX, -999.0), S.NY, S.NX).where(F.col("value") != -999.0)


@query("iy:i ix:i x:f y:f", "B20", """
    SELECT iy, ix, CASE WHEN height < 0 THEN ix * 1000.0 WHEN region < 12 THEN lon * 1000 ELSE (ix * 2 + 1) * 1000.0 END AS x,
    CASE WHEN height < 0 THEN iy * 1000.0 WHEN region < 12 THEN lat * 1000 ELSE (iy * 2 + 1) * 1000.0 END AS y FROM grid_cells""")
def projected_axes(spark, sf):
    g = S.grid(spark, sf)
    own = g.withColumns({"x": F.when((F.col("region") < 12) & (F.col("height") >= 0), F.col("lon")), "y": F.when((F.col("region") < 12) & (F.col("height") >= 0), F.col("lat"))})
    borrowed = g.where("height >= 0").select("iy", "ix", (F.col("ix") * 2.0 + 1).alias("x"), (F.col("iy") * 2.0 + 1).alias("y"))
    return geometry.projected_axes(own, borrowed, in_km=True)


# --- temporal aggregation ------------------------------------------------------------------------------

@query("time:t iy:i ix:i value:f", "D2", "SELECT time_bucket(INTERVAL 6 HOUR, time) AS time, iy, ix, avg(value) AS value FROM event_points GROUP BY 1, 2, 3")
def resample_six_hours(spark, sf):
    return timeops.resample(S.event_points(spark, sf), ["iy", "ix"], "hourly", "6h", "mean")


@query("time:t iy:i ix:i value:f", "D2", "SELECT time_bucket(INTERVAL 3 HOUR, time) AS time, iy, ix, sum(value) AS value FROM event_points GROUP BY 1, 2, 3")
def resample_three_hour_sum(spark, sf):
    return timeops.resample(S.event_points(spark, sf), ["iy", "ix"], "1h", "3hourly", "sum")


@query("time:d iy:i ix:i value:f", "D3", "SELECT date_trunc('day', time)::TIMESTAMP AS time, iy, ix, avg(value) AS value FROM event_points GROUP BY 1, 2, 3")
def daily_mean(spark, sf):
    return timeops.daily_mean(S.event_points(spark, sf))


@query("time:d iy:i ix:i obs:f raw:f", "D4", """
    SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, CASE WHEN count(obs) = count(*) THEN avg(obs) END AS obs, avg(raw) AS raw FROM daily_points GROUP BY 1, 2, 3""")
def monthly_mean_strict(spark, sf):
    return timeops.monthly_mean(S.daily_points(spark, sf), values=("obs", "raw"), skipna=False)


@query("time:d iy:i ix:i obs:f", "D4", "SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(obs) AS obs FROM daily_points GROUP BY 1, 2, 3")
def monthly_mean_skipping(spark, sf):
    return timeops.monthly_mean(S.daily_points(spark, sf), values=("obs",))


# --- scalar functions ----------------------------------------------------------------------------------

@query("vec_id:l speed:f direction:f", "H1 H2", "SELECT vec_id, sqrt(u * u + v * v) AS speed, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS direction FROM vector_parts")
def wind_speed_direction(spark, sf):
    return S.vectors(spark, sf).select("vec_id", C.wind_speed("u", "v").alias("speed"), C.wind_from_direction("u", "v").alias("direction"))


@query("iy:i ix:i height:f", "H12", "SELECT iy, ix, coalesce(CASE WHEN region <> 5 THEN height END, 0) / 9.80665 AS height FROM grid_cells")
def geopotential_height(spark, sf):
    return S.grid(spark, sf).select("iy", "ix", C.geopotential_height(F.when(F.col("region") != 5, F.col("height"))).alias("height"))


@query("iy:i ix:i lon_lo:f lon_hi:f lat_lo:f lat_hi:f", "H13", """
    WITH xs AS (SELECT lon, lag(lon) OVER w AS a, lead(lon) OVER w AS b FROM (SELECT DISTINCT lon FROM grid_cells) WINDOW w AS (ORDER BY lon)),
    ys AS (SELECT lat, lag(lat) OVER w AS a, lead(lat) OVER w AS b FROM (SELECT DISTINCT lat FROM grid_cells) WINDOW w AS (ORDER BY lat))
    SELECT iy, ix, coalesce((xs.a + lon) / 2, lon - (xs.b - lon) / 2) AS lon_lo, coalesce((xs.b + lon) / 2, lon + (lon - xs.a) / 2) AS lon_hi,
    coalesce((ys.a + lat) / 2, lat - (ys.b - lat) / 2) AS lat_lo, coalesce((ys.b + lat) / 2, lat + (lat - ys.a) / 2) AS lat_hi
    FROM grid_cells JOIN xs USING (lon) JOIN ys USING (lat)""")
def cell_bounds(spark, sf):
    return geometry.grid_with_bounds(S.grid(spark, sf))


@query("grid_id:s signature:s", "H14", """
    SELECT 'supplier_grid' AS grid_id, printf('%dx%d_%.6f_%.6f_%.6f_%.6f', count(DISTINCT lon), count(DISTINCT lat), min(lon), max(lon), min(lat), max(lat)) AS signature FROM grid_cells""")
def grid_signature(spark, sf):
    return geometry.grid_signature(S.grid(spark, sf))


@query("p_partkey:l unit:s", "H15", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'mm/day' WHEN 2 THEN 'm/s' ELSE 'Pa' END AS unit FROM part""")
def variable_units(spark, sf):
    names = F.element_at(F.array(*[F.lit(v) for v in ("tas", "pr", "sfcWind", "psl")]), F.col("p_size") % 4 + 1)
    return S.table(spark, sf, "part").select("p_partkey", L.unit_of(names).alias("unit"))


@query("p_partkey:l label:s hours:i token:s resolved:s", "H16", """
    WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' 1D ' WHEN 1 THEN 'HR' WHEN 2 THEN '3hourly' WHEN 3 THEN '6h' WHEN 4 THEN '12h' END AS f, p_size FROM part),
    n AS (SELECT *, CASE p_size % 6 WHEN 1 THEN 'hourly' WHEN 2 THEN '3h' WHEN 3 THEN '6h' WHEN 4 THEN '12h' ELSE 'daily' END AS label FROM t)
    SELECT p_partkey, label, CASE label WHEN 'hourly' THEN 1 WHEN '3h' THEN 3 WHEN '6h' THEN 6 WHEN '12h' THEN 12 ELSE 24 END AS hours,
    CASE label WHEN 'daily' THEN 'day' WHEN 'hourly' THEN '1h' ELSE label END AS token, CASE WHEN f IS NULL THEN '3h' ELSE label END AS resolved FROM n""")
def frequency_labels(spark, sf):
    spell = F.try_element_at(F.array(*[F.lit(v) for v in (" 1D ", "HR", "3hourly", "6h", "12h")]), F.col("p_size") % 6 + 1)
    return S.table(spark, sf, "part").select(
        "p_partkey", L.frequency_label(spell).alias("label"), L.frequency_hours(spell).alias("hours"), L.frequency_token(spell).alias("token"),
        L.resolve_frequency(spell, F.lit("3hr")).alias("resolved"))


@query("s_suppkey:l time:t", "H17", """
    WITH s AS (SELECT s_suppkey, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * s_nationkey AS a, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * (s_nationkey + s_suppkey % 3) AS b FROM supplier)
    SELECT s_suppkey, unnest(generate_series(a, b + INTERVAL 1 DAY - INTERVAL 3 HOUR, INTERVAL 3 HOUR)) AS time FROM s""")
def time_range_three_hours(spark, sf):
    base = F.lit("2000-01-01").cast("date")
    spans = S.table(spark, sf, "supplier").select("s_suppkey", F.date_add(base, F.col("s_nationkey")).alias("a"), F.date_add(base, (F.col("s_nationkey") + F.col("s_suppkey") % 3).cast("int")).alias("b"))
    return L.times_between(spans, "a", "b", "3h")


@query("event_id:l day_token:s hour_token:s", "H18", "SELECT event_id, strftime(ts, '%Y%m%d') AS day_token, strftime(ts, '%Y%m%d%H') AS hour_token FROM events")
def time_tokens(spark, sf):
    return S.event_points(spark, sf).select("event_id", L.time_token("time").alias("day_token"), L.time_token("time", "3h").alias("hour_token"))


@query("o_orderkey:l start:s end:s label:s parsed:s", "H18 H19", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') AS "end",
    strftime(o_orderdate, '%Y') || '-' || strftime(o_orderdate + INTERVAL 400 DAY, '%Y') AS label, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def names_with_dates(spark, sf):
    a, b = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyyMMdd")
    named = S.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("tas_day_"), a, F.lit("_"), b, F.lit(".nc")).alias("file"), F.concat(F.lit("x/sample_"), a, F.lit(".npz")).alias("sample"), F.concat_ws("_", a, b).alias("window"))
    start, end = L.span_from_name("file")
    return named.select("o_orderkey", F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("end"), L.window_label("window").alias("label"),
                        F.date_format(L.date_from_sample_name("sample"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("model:s label:s", "H19", """
    SELECT DISTINCT 'bc_baseline_' || replace(lower(p_type), ' ', '_') AS model, 'BC baseline (' || lower(p_type) || ')' AS label FROM part
    UNION ALL SELECT DISTINCT p_brand, CASE WHEN p_brand = 'Brand#1' THEN 'First brand' ELSE p_brand END FROM part""")
def display_labels(spark, sf):
    part = S.table(spark, sf, "part")
    names = part.select(F.concat(F.lit("bc_baseline_"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("model")).union(part.select("p_brand")).distinct()
    return names.select("model", L.display_label("model", {"Brand#1": "First brand"}).alias("label"))


@query("p_partkey:l source:s tag:s grouped:s", "H20", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'model_a' WHEN p_size % 3 = 1 THEN 'model_b' END AS source, replace(trim(p_name), ' ', '_') AS tag,
    replace(p_name, ' ', '_') AS grouped FROM part""")
def variant_names(spark, sf):
    variant = F.when(F.col("p_size") % 3 == 0, "gcm_bc_two_step").when(F.col("p_size") % 3 == 1, "model_b").otherwise("unknown")
    return S.table(spark, sf, "part").select(
        "p_partkey", L.variant_source(variant, {"gcm": "model_a", "rcm": "model_b"}, ["model_a", "model_b"], unknown="null").alias("source"), L.tag_label("p_name").alias("tag"),
        L.variable_group(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("grouped"))


@query("iy:i ix:i inside:i", "H21", "SELECT iy, ix, CAST(lon BETWEEN 72 AND 180 AND lat BETWEEN 10 AND 22 AS INTEGER) AS inside FROM grid_cells")
def extent_predicate(spark, sf):
    return S.grid(spark, sf).select("iy", "ix", L.inside_extent("lon", "lat", (72, 180, 10, 22)).cast("int").alias("inside"))


# --- regridding ----------------------------------------------------------------------------------------

def coarse_grid(spark, sf, cols=4, rows=3):
    """A regular target grid spanning the supplier grid: axis lines derived from its extremes."""
    g = S.grid(spark, sf).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    xs = F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    ys = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    return g.withColumn("ix", xs).withColumn("iy", ys).select(
        F.lit("coarse").alias("grid_id"), "iy", "ix", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("ix") + 0.5) / cols).alias("lon"),
        (F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("iy") + 0.5) / rows).alias("lat"))


_COARSE = """coarse AS (SELECT CAST(b.i AS INTEGER) AS iy, CAST(a.i AS INTEGER) AS ix, x0 + (x1 - x0) * (a.i + 0.5) / 4 AS lon, y0 + (y1 - y0) * (b.i + 0.5) / 3 AS lat
    FROM (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM grid_cells), range(4) a(i), range(3) b(i))"""


def _bounds_sql(name: str, grid: str, coord: str, index: str) -> str:
    return f"""{name} AS (SELECT i, c, coalesce((lag(c) OVER w + c) / 2, c - (lead(c) OVER w - c) / 2) AS lo, coalesce((lead(c) OVER w + c) / 2, c + (c - lag(c) OVER w) / 2) AS hi
        FROM (SELECT DISTINCT {index} AS i, {coord} AS c FROM {grid}) WINDOW w AS (ORDER BY c))"""


_CONSERVATIVE = f"""{_COARSE}, {_bounds_sql('sx', 'grid_cells', 'lon', 'ix')}, {_bounds_sql('dx', 'coarse', 'lon', 'ix')}, {_bounds_sql('sy', 'grid_cells', 'lat', 'iy')}, {_bounds_sql('dy', 'coarse', 'lat', 'iy')},
    ox AS (SELECT sx.i AS s, dx.i AS d, least(sx.hi, dx.hi) - greatest(sx.lo, dx.lo) AS size FROM sx JOIN dx ON least(sx.hi, dx.hi) > greatest(sx.lo, dx.lo)),
    oy AS (SELECT sy.i AS s, dy.i AS d, sin(radians(least(sy.hi, dy.hi))) - sin(radians(greatest(sy.lo, dy.lo))) AS size FROM sy JOIN dy ON least(sy.hi, dy.hi) > greatest(sy.lo, dy.lo)),
    weights AS (SELECT oy.s AS src_iy, ox.s AS src_ix, oy.d AS dst_iy, ox.d AS dst_ix, oy.size / sum(oy.size) OVER (PARTITION BY oy.d, ox.s, ox.d) * ox.size / sum(ox.size) OVER (PARTITION BY ox.d, oy.s, oy.d) AS w FROM ox, oy)"""

_LINEAR = f"""{_COARSE},
    lx AS (SELECT DISTINCT ix AS i, lon AS c FROM grid_cells), ly AS (SELECT DISTINCT iy AS i, lat AS c FROM grid_cells),
    tx AS (SELECT DISTINCT ix AS d, greatest(least(lon, (SELECT max(c) FROM lx)), (SELECT min(c) FROM lx)) AS t FROM wide),
    ty AS (SELECT DISTINCT iy AS d, greatest(least(lat, (SELECT max(c) FROM ly)), (SELECT min(c) FROM ly)) AS t FROM wide),
    bx AS (SELECT d, t, max(c) AS c0, (SELECT min(c) FROM lx l2 WHERE l2.c > max(lx.c)) AS c1 FROM tx JOIN lx ON c <= t GROUP BY d, t),
    by_ AS (SELECT d, t, max(c) AS c0, (SELECT min(c) FROM ly l2 WHERE l2.c > max(ly.c)) AS c1 FROM ty JOIN ly ON c <= t GROUP BY d, t),
    wx AS (SELECT d, i, CASE WHEN c = c0 THEN 1 - coalesce((t - c0) / (c1 - c0), 0) ELSE (t - c0) / (c1 - c0) END AS w FROM bx JOIN lx ON c = c0 OR c = c1),
    wy AS (SELECT d, i, CASE WHEN c = c0 THEN 1 - coalesce((t - c0) / (c1 - c0), 0) ELSE (t - c0) / (c1 - c0) END AS w FROM by_ JOIN ly ON c = c0 OR c = c1),
    weights AS (SELECT wy.i AS src_iy, wx.i AS src_ix, wy.d AS dst_iy, wx.d AS dst_ix, wx.w * wy.w AS w FROM wx, wy WHERE wx.w * wy.w > 0)"""
_LINEAR = _LINEAR.replace(_COARSE + ",", _COARSE + ", wide AS (SELECT iy, ix, lon * 1.4 - 40 AS lon, lat * 1.3 - 5 AS lat FROM coarse),", 1)
_APPLY = """SELECT time, dst_iy AS iy, dst_ix AS ix, CASE WHEN count(value) = max(need) THEN sum(w * value) END AS value
    FROM (SELECT *, count(*) OVER (PARTITION BY dst_iy, dst_ix) AS need FROM weights) JOIN src ON src.iy = src_iy AND src.ix = src_ix GROUP BY 1, 2, 3"""


def wide_grid(spark, sf):
    """The coarse grid stretched beyond the source grid on all sides."""
    return coarse_grid(spark, sf).withColumns({"lon": F.col("lon") * 1.4 - 40, "lat": F.col("lat") * 1.3 - 5})


@query("src_iy:i src_ix:i dst_iy:i dst_ix:i w:f", "C4", f"WITH {_CONSERVATIVE} SELECT * FROM weights WHERE w > 0")
def conservative_weights(spark, sf):
    return regrid.conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))


@query("src_iy:i src_ix:i dst_iy:i dst_ix:i w:f", "C5", f"WITH {_LINEAR} SELECT * FROM weights")
def bilinear_weights(spark, sf):
    return regrid.bilinear_weights(S.grid(spark, sf), wide_grid(spark, sf))


@query("time:d iy:i ix:i value:f", "C3", f"WITH {_CONSERVATIVE}, src AS (SELECT time, iy, ix, obs AS value FROM monthly_points) {_APPLY}")
def regrid_strict(spark, sf):
    weights = regrid.conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))
    return regrid.regrid(S.monthly_points(spark, sf).withColumnRenamed("obs", "value"), weights)


@query("time:d iy:i ix:i value:f", "C3", f"""WITH {_CONSERVATIVE}, src AS (SELECT time, iy, ix, obs AS value FROM daily_points)
    SELECT time, dst_iy AS iy, dst_ix AS ix, sum(w * value) / sum(w) FILTER (value IS NOT NULL) AS value FROM weights JOIN src ON src.iy = src_iy AND src.ix = src_ix WHERE w > 0 GROUP BY 1, 2, 3""")
def regrid_renormalised(spark, sf):
    weights = regrid.conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))
    return regrid.regrid(S.observed(spark, sf), weights, renormalise=True)


_CHAIN = f"""{_CONSERVATIVE}, w2 AS (SELECT * FROM weights),
    back AS (SELECT g.iy AS dst_iy, g.ix AS dst_ix, first(c.iy ORDER BY abs(c.lon - g.lon) + abs(c.lat - g.lat), c.iy, c.ix) AS src_iy, first(c.ix ORDER BY abs(c.lon - g.lon) + abs(c.lat - g.lat), c.iy, c.ix) AS src_ix FROM grid_cells g, coarse c GROUP BY 1, 2),
    both_ways AS (SELECT a.src_iy, a.src_ix, b.dst_iy, b.dst_ix, sum(a.w) AS w FROM w2 a JOIN back b ON a.dst_iy = b.src_iy AND a.dst_ix = b.src_ix WHERE a.w > 0 GROUP BY 1, 2, 3, 4)"""


@query("dst_iy:i dst_ix:i total:f n:l", "C6", f"""WITH {_CONSERVATIVE}, fine AS (SELECT src_iy AS dst_iy, src_ix AS dst_ix, dst_iy AS src_iy, dst_ix AS src_ix,
    w / sum(w) OVER (PARTITION BY src_iy, src_ix) AS w FROM weights WHERE w > 0)
    SELECT dst_iy, dst_ix, sum(w) AS total, count(*) AS n FROM (SELECT a.src_iy, a.src_ix, b.dst_iy, b.dst_ix, sum(a.w * b.w) AS w
    FROM weights a JOIN fine b ON a.dst_iy = b.src_iy AND a.dst_ix = b.src_ix WHERE a.w > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
def bridge_weights(spark, sf):
    first = regrid.conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))
    totals = first.groupBy("src_iy", "src_ix").agg(F.sum("w").alias("t"))
    second = first.join(totals, ["src_iy", "src_ix"]).select(
        F.col("dst_iy").alias("src_iy"), F.col("dst_ix").alias("src_ix"), F.col("src_iy").alias("dst_iy"), F.col("src_ix").alias("dst_ix"), (F.col("w") / F.col("t")).alias("w"))
    return regrid.chain_weights(first, second).per_target()


@query("time:d iy:i ix:i value:f", "C7", f"""WITH {_COARSE},
    points AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 36000) / 100.0::DOUBLE AS lon, (c_custkey * 53 % 4000) / 100.0::DOUBLE AS lat FROM customer),
    hits AS (SELECT point_id, arg_min(struct_pack(iy := iy, ix := ix), ((coarse.lon - points.lon) * (coarse.lon - points.lon) + (coarse.lat - points.lat) * (coarse.lat - points.lat), iy, ix)) AS c FROM points, coarse GROUP BY 1)
    SELECT o_orderdate AS time, c.iy AS iy, c.ix AS ix, arg_max(v, o_custkey) AS value FROM (SELECT o_orderdate, o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) JOIN hits ON point_id = o_custkey GROUP BY 1, 2, 3""")
def nearest_scatter(spark, sf):
    key = F.col("c_custkey")
    points = S.table(spark, sf, "customer").select(key.alias("point_id"), ((key * 37 % 36000) / 100.0).alias("lon"), ((key * 53 % 4000) / 100.0).alias("lat"))
    cells = regrid.nearest_cells(points, coarse_grid(spark, sf), 30.0)
    values = S.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("time"), F.col("o_custkey").alias("point_id")).agg(F.avg("o_totalprice").alias("value"))
    return regrid.scatter_points(values, cells)


@query("event_id:l time:t value:f", "C8", """
    WITH q AS (SELECT event_id, iy, ix, time + INTERVAL 3 HOUR AS "at" FROM event_points WHERE event_type = 'click'),
    p AS (SELECT iy, ix, time, avg(value) AS value FROM event_points WHERE event_type <> 'click' GROUP BY 1, 2, 3)
    SELECT event_id, arg_min(p.time, (abs(epoch_us(p.time) - epoch_us("at")), p.time)) AS time, arg_min(value, (abs(epoch_us(p.time) - epoch_us("at")), p.time)) AS value
    FROM q JOIN p USING (iy, ix) GROUP BY event_id""")
def nearest_in_time(spark, sf):
    e = S.event_points(spark, sf)
    requests = e.where("event_type = 'click'").select("event_id", "iy", "ix", (F.col("time") + F.expr("INTERVAL '3' HOUR")).alias("at"))
    others = e.where("event_type <> 'click'").groupBy("iy", "ix", "time").agg(F.avg("value").alias("value"))
    found = timeops.nearest_in_time(others, requests.select("at", "iy", "ix").distinct())
    return requests.join(found, ["at", "iy", "ix"])


@query("time:d iy:i ix:i value:f", "B7", f"""WITH {_CONSERVATIVE}, hit AS (SELECT src_iy AS iy, src_ix AS ix, 1 AS hit FROM weights WHERE w > 0 GROUP BY 1, 2 HAVING bool_and(dst_iy * 4 + dst_ix IN (1, 5, 6, 11)))
    SELECT time, iy, ix, CASE WHEN hit IS NULL THEN obs END AS value FROM daily_points LEFT JOIN hit USING (iy, ix)""")
def region_mask(spark, sf):
    """Regions come as a raster of a coarser grid, whose indicator is regridded."""
    coarse, fine = coarse_grid(spark, sf), S.grid(spark, sf)
    raster = coarse.select("iy", "ix", (F.col("iy") * 4 + F.col("ix")).alias("region"))
    return masks.null_regions(S.observed(spark, sf), raster, (1, 5, 6, 11), regrid.conservative_weights(coarse, fine))


@query("time:d iy:i ix:i value:f", "B7", """
    SELECT time, iy, ix, CASE WHEN region IN (3, 7, 11) THEN NULL ELSE obs END AS value FROM daily_points LEFT JOIN grid_cells USING (iy, ix)""")
def region_mask_own_grid(spark, sf):
    return masks.null_regions(S.observed(spark, sf), S.grid(spark, sf).select("iy", "ix", "region"), (3, 7, 11))


@query("time:d iy:i ix:i value:f", "C15", f"""WITH {_COARSE}, h AS (SELECT iy, ix, least(greatest(lon, (SELECT min(lon) FROM coarse)), (SELECT max(lon) FROM coarse)) AS x, least(greatest(lat, (SELECT min(lat) FROM coarse)), (SELECT max(lat) FROM coarse)) AS y FROM grid_cells)
    SELECT time, iy, ix, obs + ((x * 2 - y * 4 + 10) - (x * 3 + y * 5)) * -0.0065 AS value FROM daily_points JOIN h USING (iy, ix)""")
def lapse_rate(spark, sf):
    """Both heights lie on the coarse grid, linear in its coordinates, which bilinear weights bring exactly to the field."""
    coarse, fine = coarse_grid(spark, sf), S.grid(spark, sf)
    height = lambda h: coarse.select("iy", "ix", h.alias("height"))
    lon, lat, weights = F.col("lon"), F.col("lat"), regrid.bilinear_weights(coarse, fine)
    field = S.observed(spark, sf).withColumn("variable", F.lit("tas"))
    return regrid.lapse_rate_correction(field, height(lon * 3 + lat * 5), height(lon * 2 - lat * 4 + 10), source_weights=weights, target_weights=weights)


@query("time:d iy:i ix:i value:f", "C15", """
    WITH m AS (SELECT avg(height) AS h FROM grid_cells)
    SELECT time, iy, ix, obs + (h - height) * -0.0065 AS value FROM daily_points JOIN grid_cells USING (iy, ix), m""")
def lapse_rate_own_grid(spark, sf):
    g = S.grid(spark, sf)
    smooth = g.select("iy", "ix", g.agg(F.avg("height").alias("h")).scalar().alias("height"))
    field = S.observed(spark, sf).withColumn("variable", F.lit("tas"))
    return regrid.lapse_rate_correction(field, g.select("iy", "ix", "height"), smooth)


@query("time:d mode:s mad:f rmse:f max_abs:f mean_diff:f", "C17", f"""WITH {_CONSERVATIVE}, src AS (SELECT time, iy, ix, raw AS value, obs FROM monthly_points),
    r AS (SELECT time, dst_iy AS iy, dst_ix AS ix, sum(w * value) / sum(w) AS value, sum(w * obs) / sum(w) FILTER (obs IS NOT NULL) AS obs, count(*) AS n, avg(value) AS plain FROM weights JOIN src ON src.iy = src_iy AND src.ix = src_ix WHERE w > 0 GROUP BY 1, 2, 3),
    u AS (SELECT time, 'conservative' AS mode, value - obs AS d FROM r UNION ALL SELECT time, 'plain', plain - obs FROM r)
    SELECT time, mode, avg(abs(d)) AS mad, sqrt(avg(d * d)) AS rmse, max(abs(d)) AS max_abs, avg(d) AS mean_diff FROM u GROUP BY 1, 2""")
def regrid_modes(spark, sf):
    weights = regrid.conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))
    p = S.monthly_points(spark, sf)
    sim = p.select("time", "iy", "ix", F.col("raw").alias("value"))
    modes = {"conservative": regrid.regrid(sim, weights, renormalise=True), "plain": regrid.regrid(sim, weights.withColumn("w", F.lit(1.0)), renormalise=True)}
    return regrid.compare_modes(modes, regrid.regrid(p.select("time", "iy", "ix", F.col("obs").alias("value")), weights, renormalise=True))
