"""Sources and sinks, normalisation, distribution mapping, scoring, streams and composite jobs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import gamma
from gridloom.operators import biascorr, cellwise, geometry, normalise, samples, scoring, skill, timeops
from gridloom.operators.regrid import chain_weights, conservative_weights, regrid
from gridloom.plans import composites
from gridloom.plans import standins as S
from gridloom.plans.queries_compare import xy_samples
from gridloom.plans.queries_fields import _APPLY, _CONSERVATIVE, _COARSE, coarse_grid
from gridloom.plans.queries_skill import corr_sql
from gridloom.plans.registry import query
from gridloom.session import materialise, new_path
from gridloom.sources import archive_source, catalog, readers, sinks
from gridloom.streaming import skill_stream

# --- sources and sinks ---------------------------------------------------------------------------------


def field_parts(spark, sf):
    """Fields of two variables and two scenarios: historical before 1999, scenario runs from 1998 on."""
    p = S.daily_points(spark, sf)

    def part(variable, column, scenario):
        return p.select(F.lit("model_a").alias("source"), F.lit(variable).alias("variable"), F.lit(scenario).alias("scenario"), F.lit("r1").alias("member"), "time", "iy", "ix", F.col(column).alias("value"))

    out = None
    for variable, column in (("tas", "raw"), ("pr", "bc")):
        both = timeops.filter_dates(part(variable, column, "historical"), None, "1998-12-31").unionByName(timeops.filter_dates(part(variable, column, "ssp585"), "1998-01-01"))
        out = both if out is None else out.unionByName(both)
    return out


def stored_catalog(spark, sf):
    root = new_path(spark, "catalog")
    catalog.write_field(field_parts(spark, sf), root)
    return catalog.open_catalog(spark, root)


@query("source:s variable:s scenario:s time:d iy:i ix:i value:f", "A1", """
    SELECT 'model_a' AS source, 'tas' AS variable, 'historical' AS scenario, time, iy, ix, raw AS value FROM daily_points WHERE time >= '1996-03-01' AND time < '1997-04-01'""")
def catalog_scan(spark, sf):
    return catalog.require_source(stored_catalog(spark, sf), "model_a", "tas", "1996-03-01", "1997-03-31", ["historical"])


@query("scenario:s time:d iy:i ix:i value:f", "A2", """
    SELECT CASE WHEN time < '1999-01-01' THEN 'historical' ELSE 'ssp585' END AS scenario, time, iy, ix, bc AS value FROM daily_points WHERE time >= '1998-06-01' AND time < '1999-07-01'""")
def scenario_routing(spark, sf):
    return catalog.scan_routed(stored_catalog(spark, sf), "model_a", "pr", "ssp585", "1998-06-01", "1999-06-30", split="1999-01-01")


@query("time:d x:i y:i value:f", "A3 B2", "SELECT time, ix AS x, iy AS y, raw AS value FROM daily_points")
def concatenated_files(spark, sf):
    from gridloom.operators.geometry import standard_coordinates

    p = S.daily_points(spark, sf)
    odd = timeops.filter_dates(p, None, "1997-12-31").select("time", F.col("ix").alias("nlon"), F.col("iy").alias("nlat"), F.col("raw").alias("value"))
    even = timeops.filter_dates(p, "1998-01-01").select("time", F.col("ix").alias("i"), F.col("iy").alias("j"), F.col("raw").alias("value"))
    return catalog.concat_in_time([odd, even], standard_coordinates)


@query("o_orderkey:l part:s", "A4", "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1996 THEN 'p1995_1996' WHEN year(o_orderdate) <= 1999 THEN 'p1997_1999' ELSE 'p2000_2005' END AS part FROM orders")
def file_spans(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    manifest = spark.createDataFrame([(f"p{a}_{b}", a, b) for a, b in ((1995, 1996), (1997, 1999), (2000, 2005))], "part string, start_year int, end_year int")
    return catalog.in_span(manifest, orders)


@query("brand:s matches:l verdict:s", "A5", """
    SELECT b.p_brand AS brand, count(p.p_brand) AS matches, CASE count(p.p_brand) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS verdict
    FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT p_brand FROM part WHERE p_retailprice < 903) p USING (p_brand) GROUP BY 1""")
def unique_match(spark, sf):
    part = S.table(spark, sf, "part").withColumnRenamed("p_brand", "brand")
    return catalog.match_counts(part.where("p_retailprice < 903"), part, "brand")


CHANNELS = ["elevation", "raw input"]


def tile_heights(spark, sf):
    return S.table(spark, sf, "supplier").groupBy(F.floor((F.col("s_suppkey") % 100) / 10).cast("int").alias("iy"), (F.col("s_suppkey") % 10).cast("int").alias("ix")).agg(F.avg("s_acctbal").alias("value"))


def tile_samples(spark, sf):
    p = S.tile_points(spark, sf)
    field = lambda c: p.select("time", "iy", "ix", F.col(c).alias("value"))
    return samples.stack_channels({"raw input": field("raw")}, tile_heights(spark, sf), target=field("obs"))


_TILE_HEIGHTS = "SELECT CAST((s_suppkey % 100) // 10 AS INTEGER) AS iy, CAST(s_suppkey % 10 AS INTEGER) AS ix, avg(s_acctbal) AS value FROM supplier GROUP BY 1, 2"
_TILE_SAMPLES = f"""SELECT time, 'x' AS role, 'elevation' AS channel, iy, ix, value::FLOAT AS value FROM tile_points JOIN ({_TILE_HEIGHTS}) USING (iy, ix)
    UNION ALL SELECT time, 'x', 'raw input', iy, ix, raw::FLOAT FROM tile_points UNION ALL SELECT time, 'y', 'target', iy, ix, obs::FLOAT FROM tile_points"""


@query("time:d role:s channel:s iy:i ix:i value:f", "C2", _TILE_SAMPLES)
def stacked_channels(spark, sf):
    return tile_samples(spark, sf)


@query("time:d role:s channel_pos:i iy:i ix:i value:f", "A6", f"""
    SELECT time, role, CASE channel WHEN 'raw input' THEN 1 ELSE 0 END AS channel_pos, iy, ix, value FROM ({_TILE_SAMPLES}) WHERE value IS NOT NULL""")
def archive_roundtrip(spark, sf):
    return archive_source.scan_archives(spark, archive_folder(spark, sf)).where("value is not null")


def archive_folder(spark, sf):
    """Real files, one for each day."""
    folder = new_path(spark, "archives")
    archive_source.write_archives(tile_samples(spark, sf), folder, CHANNELS, S.NY, S.NX)
    return folder


@query("time:d role:s channel_pos:i iy:i ix:i value:f", "A6", f"""
    SELECT time, role, CASE channel WHEN 'raw input' THEN 1 ELSE 0 END AS channel_pos, iy, ix, value FROM ({_TILE_SAMPLES}) WHERE value IS NOT NULL AND time >= '1997-03-05' AND time < '1998-11-02'""")
def archive_window(spark, sf):
    return archive_source.scan_archives(spark, archive_folder(spark, sf), "1997-03-05", "1998-11-01").where("value is not null")


@query("date:s roles:s channels:i ny:i nx:i dtypes:s expected:s status:s", "A6 K2", f"""
    SELECT strftime(time, '%Y-%m-%d') AS date, roles, 2 AS channels, {S.NY} AS ny, {S.NX} AS nx, 'float32' AS dtypes, CASE WHEN time < '2001-01-01' THEN 'x,y' ELSE 'x' END AS expected,
    CASE WHEN roles = CASE WHEN time < '2001-01-01' THEN 'x,y' ELSE 'x' END THEN 'ok' ELSE 'fail' END AS status
    FROM (SELECT time, CASE WHEN count(*) FILTER (role = 'y' AND value IS NOT NULL) > 0 THEN 'x,y' ELSE 'x' END AS roles FROM ({_TILE_SAMPLES}) GROUP BY 1 HAVING count(value) > 0)""")
def archive_structure(spark, sf):
    headers = archive_source.archive_headers(spark, archive_folder(spark, sf))
    return archive_source.archive_structure(headers, "2000-12-31").withColumn("date", F.col("date").cast("string"))


@query("token:s channel:s n:l total:f", "A7", f"""
    SELECT strftime(time, '%Y%m%d') AS token, channel, count(value) AS n, sum(value::DOUBLE) AS total FROM ({_TILE_SAMPLES}) GROUP BY 1, 2""")
def sample_sink(spark, sf):
    path = new_path(spark, "samples")
    rows = tile_samples(spark, sf)
    sinks.write_samples(timeops.filter_dates(rows, None, "1997-06-30"), path)
    sinks.write_samples(rows, path)  # only the times not written yet
    return sinks.read_samples(spark, path).groupBy("token", "channel").agg(F.count("value").alias("n"), F.sum(F.col("value").cast("double")).alias("total"))


@query("period:s time:d iy:i ix:i obs:f sim:f", "A8", "SELECT period, time, iy, ix, CASE WHEN period <> 'test_future' THEN obs END AS obs, raw AS sim FROM period_points")
def period_bundle(spark, sf):
    p = S.daily_points(spark, sf)
    bundle = sinks.build_bundle(p.select("time", "iy", "ix", F.col("raw").alias("value")), p.select("time", "iy", "ix", F.col("obs").alias("value")), S.PERIODS)
    path = new_path(spark, "bundle")
    sinks.write_bundle(bundle, path)
    return spark.read.parquet(path)


@query("variable:s period:s time:d iy:i ix:i lon:f lat:f value:f", "A9 C16", "SELECT 'tas' AS variable, period, time, iy, ix, lon, lat, bc AS value FROM period_points JOIN grid_cells USING (iy, ix)")
def corrected_series(spark, sf):
    path = new_path(spark, "corrected")
    sinks.write_corrected(S.period_points(spark, sf).select(F.lit("tas").alias("variable"), "period", "time", "iy", "ix", F.col("bc").alias("value")), S.grid(spark, sf), path)
    return spark.read.parquet(path)


@query("period:s time:d iy:i ix:i raw:f", "A10", "SELECT period, time, iy, ix, raw FROM period_points WHERE time >= '1998-05-01' AND time < '2001-03-01'")
def stitched_window(spark, sf):
    return catalog.stitch_periods(S.period_points(spark, sf), S.PERIODS, ("1998-05-01", "2001-02-28"))


_CHUNK_SPANS = [("1995-01-01", "1997-12-31"), ("1997-07-01", "1999-12-31"), ("1999-11-01", "2001-12-31")]


@query("time:d iy:i ix:i value:f", "A11", "SELECT time, iy, ix, raw + CASE WHEN time < '1998-01-01' THEN 0 WHEN time < '2000-01-01' THEN 1 ELSE 2 END AS value FROM daily_points WHERE time >= '1997-02-01' AND time < '2000-06-01'")
def prediction_window(spark, sf):
    p = S.daily_points(spark, sf)
    spans = F.array(*[F.struct(F.lit(a).cast("date").alias("chunk_start"), F.lit(b).cast("date").alias("chunk_end"), F.lit(i).alias("k")) for i, (a, b) in enumerate(_CHUNK_SPANS)])
    day = F.to_date("time")
    held = F.explode(F.filter(spans, lambda s: (s["chunk_start"] <= day) & (day <= s["chunk_end"]))).alias("s")
    chunks = p.select("time", "iy", "ix", "raw", held).select("s.chunk_start", "s.chunk_end", "time", "iy", "ix", (F.col("raw") + F.col("s.k")).alias("value"))
    return catalog.prediction_window(chunks, "1997-02-01", "2000-05-31")


@query("method:s n:l rmse:f has_file:i", "A12 A13", "SELECT method, count(*) AS n, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, 1 AS has_file FROM method_points GROUP BY 1")
def metric_files(spark, sf):
    root = new_path(spark, "metrics")
    table = skill.paired_accumulator(S.method_pairs(spark, sf), ["method"]).select("method", F.col("count").alias("n"), "rmse")
    sinks.write_metric_table(table.where("method = 'raw'"), f"{root}/chunk_raw")
    sinks.write_metric_table(table.where("method <> 'raw'"), f"{root}/chunk_other")
    stacked = sinks.read_metric_tables(spark, f"{root}/chunk_*", "method string, n bigint, rmse double")
    return stacked.withColumn("has_file", F.col("chunk_file").endswith(".csv").cast("int"))


@query("time:d iy:i ix:i value:f", "A14", "SELECT time, iy, ix, raw AS value FROM daily_points WHERE time >= '1996-01-01' AND time < '1999-01-01'")
def multi_file_scan(spark, sf):
    root = new_path(spark, "predictions")
    p = S.daily_points(spark, sf).select("time", "iy", "ix", F.col("raw").alias("value"))
    timeops.filter_dates(p, None, "1997-05-31").write.parquet(f"{root}/a")
    timeops.filter_dates(p, "1997-06-01").write.parquet(f"{root}/b")
    return timeops.filter_dates(spark.read.parquet(f"{root}/a", f"{root}/b"), "1996-01-01", "1998-12-31")


@query("dataset:s rank:i first:s last:s", "A15", """
    WITH t AS (SELECT l_returnflag || l_linestatus AS dataset, ascii(l_returnflag) * 100 + ascii(l_linestatus) AS rank, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1, 2)
    SELECT dataset, rank, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last FROM t WHERE first <= '1995-02-01' AND last >= '2001-10-01' ORDER BY rank LIMIT 1""")
def first_covering_dataset(spark, sf):
    rows = S.line_rows(spark, sf).select(F.concat("l_returnflag", "l_linestatus").alias("dataset"), (F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")).alias("rank"), "time")
    return catalog.first_covering(rows, "1995-02-01", "2001-10-01", exact=False).withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("time:d iy:i ix:i value:f", "A16", "SELECT time, iy, ix, obs AS value FROM daily_points WHERE time IN (SELECT o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')")
def requested_dates(spark, sf):
    dates = S.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date"))
    return catalog.select_dates(S.observed(spark, sf), dates)


@query("n_missing:l first_missing:s", "A16", """
    SELECT count(*) AS n_missing, CAST(min(d) AS VARCHAR) AS first_missing FROM (SELECT o_orderdate::DATE AS d FROM orders EXCEPT SELECT l_shipdate::DATE FROM lineitem)""")
def absent_requested_dates(spark, sf):
    dates = S.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return catalog.absent_dates(S.observed(spark, sf), dates).agg(F.count(F.lit(1)).alias("n_missing"), F.min("date").cast("string").alias("first_missing"))


@query("variable:s label:s unit:s", "A17", """
    SELECT DISTINCT p_brand AS variable, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'long ' || p_brand WHEN p_brand IN ('Brand#3') THEN 'standard ' || p_brand ELSE p_brand END AS label,
    CASE WHEN p_brand = 'Brand#1' THEN 'mm' WHEN p_brand = 'Brand#4' THEN 'K' ELSE '' END AS unit FROM part""")
def series_metadata(spark, sf):
    b = F.col("variable")
    meta = S.table(spark, sf, "part").select(F.col("p_brand").alias("variable")).distinct().select(
        "variable", F.when(b.isin("Brand#1", "Brand#2"), F.concat(F.lit("long "), b)).otherwise("").alias("long_name"),
        F.when(b.isin("Brand#2", "Brand#3"), F.concat(F.lit("standard "), b)).alias("standard_name"), F.when(b == "Brand#1", "mm").otherwise(" ").alias("units"))
    return catalog.series_metadata(meta, {"Brand#4": "K", "Brand#1": "m"})


# --- channel statistics and normalisation --------------------------------------------------------------

_STATS = "SELECT pos AS channel, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM channel_values GROUP BY 1"


def vector_samples(spark, sf):
    """Embedding positions as channels of a one-cell grid; the label is the target."""
    v = S.channel_values(spark, sf).select("vec_id", "label", F.col("pos").cast("string").alias("channel"), "value")
    y = S.table(spark, sf, "embeddings").select("vec_id", "label", F.lit("target").alias("channel"), F.col("label").cast("double").alias("value"))
    return v.withColumn("role", F.lit("x")).unionByName(y.withColumn("role", F.lit("y")))


@query("channel:s mean:f std:f min:f max:f", "D1 A18", f"SELECT CAST(channel AS VARCHAR) AS channel, mean, std, min, max FROM ({_STATS})")
def channel_statistics(spark, sf):
    path = new_path(spark, "statistics")
    stats = normalise.channel_statistics(vector_samples(spark, sf).where("role = 'x'"))
    sinks.freeze_statistics(stats, "run_1", path)
    return sinks.frozen_statistics(spark, "run_1", path)


@query("channel:s mean:f std:f min:f max:f", "D1 H7", """
    SELECT channel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max FROM (SELECT 'pr input' AS channel, log10(1 + obs) AS v FROM daily_points UNION ALL SELECT 'tas input', raw FROM daily_points) GROUP BY 1""")
def log_channel_statistics(spark, sf):
    p = S.daily_points(spark, sf)
    long = p.select(F.lit("pr input").alias("channel"), F.col("obs").alias("value")).unionByName(p.select(F.lit("tas input").alias("channel"), F.col("raw").alias("value")))
    return normalise.channel_statistics(long)


@query("vec_id:l role:s channel:s value:f", "H4", f"""
    SELECT vec_id, 'x' AS role, CAST(pos AS VARCHAR) AS channel, (value - mean) / nullif(std, 0) AS value FROM channel_values JOIN ({_STATS}) s ON s.channel = pos UNION ALL SELECT vec_id, 'y', 'target', label FROM embeddings""")
def standard_normalisation(spark, sf):
    rows = vector_samples(spark, sf)
    return normalise.standardise(rows, normalise.channel_statistics(rows.where("role = 'x'")))


@query("vec_id:l role:s channel:s value:f", "H5", f"""
    SELECT vec_id, 'x' AS role, CAST(pos AS VARCHAR) AS channel, (value - min) / nullif(max - min, 0) AS value FROM channel_values JOIN ({_STATS}) s ON s.channel = pos
    UNION ALL SELECT vec_id, 'y', 'target', 2 * ((label - min) / (max - min)) - 1 FROM embeddings, (SELECT * FROM ({_STATS}) WHERE channel = 63)""")
def minmax_normalisation(spark, sf):
    rows = vector_samples(spark, sf)
    return normalise.minmax(rows, normalise.channel_statistics(rows.where("role = 'x'")), "63", True, "minus_one_one")


@query("vec_id:l channel:s value:f", "H6", "SELECT vec_id, 'target' AS channel, greatest(least(label / 4.0 - 1, 1), -1) / 2 * (mx - mn) + (mx + mn) / 2 AS value FROM embeddings, (SELECT min(value) AS mn, max(value) AS mx FROM channel_values WHERE pos = 63)")
def inverse_minmax(spark, sf):
    rows = vector_samples(spark, sf)
    z = rows.where("role = 'y'").withColumn("value", F.col("value") / 4 - 1)
    return normalise.inverse_minmax(z, normalise.channel_statistics(rows.where("role = 'x'")), "63", "minus_one_one")


@query("vec_id:l channel:s value:f", "H6", "SELECT vec_id, CAST(pos AS VARCHAR) AS channel, value FROM channel_values")
def minmax_there_and_back(spark, sf):
    x = vector_samples(spark, sf).where("role = 'x'")
    stats = normalise.channel_statistics(x)
    return normalise.inverse_minmax_inputs(normalise.minmax(x, stats, "63"), stats)


@query("time:d channel:s iy:i ix:i value:f", "H7", "SELECT time, 'pr input' AS channel, iy, ix, log10(1 + obs) AS value FROM daily_points UNION ALL SELECT time, 'tas input', iy, ix, raw FROM daily_points")
def log_precipitation(spark, sf):
    p = S.daily_points(spark, sf)
    part = lambda ch, c: p.select("time", F.lit(ch).alias("channel"), "iy", "ix", F.col(c).alias("value"))
    return normalise.log_precipitation(part("pr input", "obs").unionByName(part("tas input", "raw")))


@query("time:d channel:s iy:i ix:i value:f", "H8", "SELECT time, 'raw input' AS channel, iy, ix, CASE WHEN obs IS NULL THEN -1.0 ELSE raw END AS value FROM daily_points UNION ALL SELECT time, 'ml input', iy, ix, CASE WHEN obs IS NULL THEN -1.0 ELSE ml END FROM daily_points")
def target_mask_fill(spark, sf):
    return normalise.mask_inputs(xy_samples(spark, sf), -1.0).where("role = 'x'")


@query("time:d iy:i ix:i value:f", "H8", "SELECT time, iy, ix, CASE WHEN region < 5 THEN 0.0 ELSE raw END AS value FROM daily_points JOIN grid_cells USING (iy, ix)")
def continent_mask_fill(spark, sf):
    mask = S.grid(spark, sf).select("iy", "ix", (F.col("region") * 5.0).alias("mask_value"))
    x = S.daily_points(spark, sf).select("time", "iy", "ix", F.col("raw").alias("value"))
    return normalise.mask_inputs(x, 0.0, mask)


@query("time:d iy:i ix:i value:f", "H9", "SELECT time, iy, ix, coalesce(obs, 0) AS value FROM daily_points")
def missing_fill(spark, sf):
    return normalise.fill_missing(S.observed(spark, sf), 0.0)


@query("time:d channel:s iy:i ix:i value:f", "H10", """
    SELECT time, 'raw input' AS channel, iy, ix, raw AS value FROM daily_points JOIN grid_cells USING (iy, ix) WHERE lon BETWEEN 36 AND 180 AND lat BETWEEN 8 AND 20
    UNION ALL SELECT time, 'ml input', iy, ix, ml FROM daily_points JOIN grid_cells USING (iy, ix) WHERE lon BETWEEN 36 AND 180 AND lat BETWEEN 8 AND 20""")
def sample_crop(spark, sf):
    return normalise.crop_samples(xy_samples(spark, sf).where("role = 'x'"), S.grid(spark, sf), (36.0, 180.0, 8.0, 20.0))


@query("role:s channel:s time:d n:l total:f", "H11", """
    WITH m AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(obs) AS obs, avg(raw) AS raw, avg(ml) AS ml FROM tile_points GROUP BY 1, 2, 3), s AS (SELECT min(raw) AS rl, max(raw) AS rh, min(log10(1 + ml)) AS pl, max(log10(1 + ml)) AS ph FROM m),
    c AS (SELECT 'x' AS role, 'pr input' AS channel, time, CASE WHEN obs IS NULL THEN 0 ELSE (log10(1 + ml) - pl) / (ph - pl) END AS v FROM m, s UNION ALL SELECT 'x', 'raw input', time, CASE WHEN obs IS NULL THEN 0 ELSE (raw - rl) / (rh - rl) END FROM m, s
      UNION ALL SELECT 'y', 'target', time, coalesce((obs - rl) / (rh - rl), 0) FROM m, s) SELECT role, channel, time, 1024 AS n, sum(v) AS total FROM c GROUP BY ALL""")
def transform_chain(spark, sf):
    m = timeops.monthly_mean(S.tile_points(spark, sf), values=("obs", "raw", "ml"))
    each = F.explode(F.array(
        F.struct(F.lit("x").alias("role"), F.lit("pr input").alias("channel"), F.col("ml").alias("value")),
        F.struct(F.lit("x").alias("role"), F.lit("raw input").alias("channel"), F.col("raw").alias("value")),
        F.struct(F.lit("y").alias("role"), F.lit("target").alias("channel"), F.col("obs").alias("value")))).alias("c")
    long = m.select("time", "iy", "ix", each).select("time", "iy", "ix", "c.*")
    stats = normalise.channel_statistics(long.where("role = 'x'"))
    chained = normalise.transform_chain(long, stats, "raw input", S.NY, S.NX)
    return chained.groupBy("role", "channel", "time").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


# --- distribution mapping ------------------------------------------------------------------------------

def six(c):
    """Six decimals, so that equal means stay equal whatever the order of summation; ranks depend on it."""
    return F.round(F.col(c) + 3e-9, 6)


def bundle(spark, sf):
    future = F.col("period") == "test_future"
    return S.period_points(spark, sf).select("period", "time", "iy", "ix", F.when(~future, six("obs")).alias("obs"), F.when(F.pmod(F.col("iy") * 7 + F.dayofyear("time"), F.lit(50)) != 0, six("raw")).alias("sim"))


_BUNDLE = "SELECT period, time, iy, ix, CASE WHEN period <> 'test_future' THEN round(obs + 3e-9, 6) END AS obs, CASE WHEN (iy * 7 + dayofyear(time)) % 50 <> 0 THEN round(raw + 3e-9, 6) END AS sim FROM period_points"


def nodes_sql(sorted_list: str, n: str, m: int) -> str:
    """Quantile nodes of a sorted list by exact rank arithmetic."""
    return f"list_transform(range({m + 1}), lambda i: {sorted_list}[(i * ({n} - 1)) // {m} + 1] + ((i * ({n} - 1)) % {m}) / {m} * (coalesce({sorted_list}[(i * ({n} - 1)) // {m} + 2], {sorted_list}[(i * ({n} - 1)) // {m} + 1]) - {sorted_list}[(i * ({n} - 1)) // {m} + 1]))"


def interp_sql(x: str, xs: str, ys: str, n: int, e: str = "e") -> str:
    k = f"greatest(1, least(len(list_filter({xs}, lambda {e}: {e} <= {x})), {n - 1}))"
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {xs}[1] THEN {ys}[1] + ({x} - {xs}[1]) WHEN {x} >= {xs}[{n}] THEN {ys}[{n}] + ({x} - {xs}[{n}])
      ELSE {ys}[{k}] + coalesce(({x} - {xs}[{k}]) / nullif({xs}[{k} + 1] - {xs}[{k}], 0), 0) * ({ys}[{k} + 1] - {ys}[{k}]) END"""


def cdft_sql(fit: str, apply: str, m: int, keys: str = "iy, ix", follows: str = "SELECT * FROM tf WHERE false") -> str:
    """CDF-t on quantile tables; ``fit`` and ``apply`` are relations (keys, period, obs, sim); ``follows`` adds tables."""
    return f"""s AS (SELECT {keys}, 'obs' AS series, obs AS v FROM {fit} WHERE period = 'train_hist' AND obs IS NOT NULL UNION ALL SELECT {keys}, period, sim FROM {fit} WHERE sim IS NOT NULL),
    l AS (SELECT {keys}, series, list_sort(list(v)) AS l, count(*) AS n, avg(v) AS mean FROM s GROUP BY ALL), q AS (SELECT {keys}, series, mean, {nodes_sql('l', 'n', m)} AS q FROM l),
    t AS (SELECT p.{keys.replace(', ', ', p.')}, p.series AS period, p.q AS xs, list_transform(p.q, lambda z: z + (o.mean - h.mean)) AS x2, list_transform(h.q, lambda z: z + (o.mean - h.mean)) AS h2, o.q AS o
      FROM q p JOIN q o USING ({keys}) JOIN q h USING ({keys}) WHERE p.series <> 'obs' AND o.series = 'obs' AND h.series = 'train_hist'),
    tf AS (SELECT {keys}, period, xs, list_transform(o, lambda y: {interp_sql('y', 'h2', 'x2', m + 1)}) AS zs FROM t), tr AS (SELECT * FROM tf UNION ALL {follows}),
    corrected AS (SELECT a.*, {interp_sql('sim', 'xs', 'zs', m + 1)} AS corrected FROM {apply} a LEFT JOIN tr USING ({keys}, period))"""


@query("period:s time:d iy:i ix:i corrected:f", "F1", f"WITH b AS ({_BUNDLE}), {cdft_sql('b', 'b', 100)} SELECT * FROM corrected")
def cdft_correction(spark, sf):
    return biascorr.cdft(bundle(spark, sf))


def sparse_bundle(spark, sf):
    """Small quantities are nulled, the limit rising with the cell, so that some cells fall below the guard."""
    large = F.expr("l_quantity > 20 + iy * 3 + ix")
    rows = S.line_rows(spark, sf).groupBy("time", "iy", "ix").agg(F.avg(F.when(large, F.col("obs"))).alias("obs"), F.avg(F.when(large, F.col("raw"))).alias("raw"))
    year = F.year("time")
    period = F.when(year <= 1998, "train_hist").when(year <= 2000, "test_hist").otherwise("test_future")
    return rows.select(period.alias("period"), "time", "iy", "ix", F.when(year <= 2000, six("obs")).alias("obs"), F.when(F.dayofyear("time") % 11 != 0, six("raw")).alias("sim"))


_SPARSE = """SELECT CASE WHEN year(time) <= 1998 THEN 'train_hist' WHEN year(time) <= 2000 THEN 'test_hist' ELSE 'test_future' END AS period, time, iy, ix, CASE WHEN year(time) <= 2000 THEN round(avg(obs) FILTER (l_quantity > 20 + iy * 3 + ix) + 3e-9, 6) END AS obs, CASE WHEN dayofyear(time) % 11 <> 0 THEN round(avg(raw) FILTER (l_quantity > 20 + iy * 3 + ix) + 3e-9, 6) END AS sim
    FROM line_rows GROUP BY time, iy, ix"""


@query("period:s time:d iy:i ix:i corrected:f", "F2 E10", f"""WITH b AS ({_SPARSE}), good AS (SELECT iy, ix FROM b GROUP BY 1, 2 HAVING count(*) FILTER (period = 'train_hist' AND obs IS NOT NULL AND sim IS NOT NULL) >= 10 AND count(sim) FILTER (period = 'test_hist') >= 10),
    kept AS (SELECT * FROM b SEMI JOIN good USING (iy, ix)), fitted AS (SELECT * FROM kept WHERE period = 'train_hist' AND obs IS NOT NULL AND sim IS NOT NULL UNION ALL
      SELECT period, time, iy, ix, obs, coalesce(sim, quantile_cont(sim, 0.5) OVER (PARTITION BY iy, ix, period)) FROM kept WHERE period = 'test_hist'),
    {cdft_sql('fitted', 'b', 100, follows="SELECT * REPLACE ('test_future' AS period) FROM tf WHERE period = 'test_hist'")} SELECT * FROM corrected""")
def guarded_cdft(spark, sf):
    return biascorr.guarded_cdft(sparse_bundle(spark, sf))


_WINDOWED_FIT = "wfit AS (SELECT b.*, k AS win FROM b JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(5)) w ON least(abs(dayofyear(time) - 0.5 - (k * 91 + 45.5)), 366 - abs(dayofyear(time) - 0.5 - (k * 91 + 45.5))) <= 75.0)"


@query("period:s time:d iy:i ix:i corrected:f", "F3", f"WITH b AS ({_BUNDLE}), {_WINDOWED_FIT}, wapply AS (SELECT *, CAST((dayofyear(time) - 1) // 91 AS INTEGER) AS win FROM b), {cdft_sql('wfit', 'wapply', 20, 'iy, ix, win')} SELECT * FROM corrected")
def running_window_cdft(spark, sf):
    return biascorr.running_window_cdft(bundle(spark, sf), width=150, step=91, steps=20)


def pair_bundle(spark, sf):
    """Two observed and two simulated variables; gaps differ between the simulated ones, and some cells lack most days."""
    p = S.period_points(spark, sf)
    past, day = F.col("period") != "test_future", F.dayofyear("time")
    seen = (F.col("iy") + F.col("ix")) % 7 != 3
    return p.select(
        "period", "time", "iy", "ix", F.when(past, six("obs")).alias("obs_u"), F.when(past, F.round(F.col("ml") * 0.5 + F.col("obs") + 3e-9, 6)).alias("obs_v"),
        F.when((day % 13 != 0) & (seen | (day < 30)), six("raw")).alias("sim_u"), F.when((day + F.col("ix")) % 11 != 0, six("bc")).alias("sim_v"),
    )


_PAIRS = """SELECT period, time, iy, ix, CASE WHEN period <> 'test_future' THEN round(obs + 3e-9, 6) END AS obs_u, CASE WHEN period <> 'test_future' THEN round(ml * 0.5 + obs + 3e-9, 6) END AS obs_v,
    CASE WHEN dayofyear(time) % 13 <> 0 AND ((iy + ix) % 7 <> 3 OR dayofyear(time) < 30) THEN round(raw + 3e-9, 6) END AS sim_u, CASE WHEN (dayofyear(time) + ix) % 11 <> 0 THEN round(bc + 3e-9, 6) END AS sim_v FROM period_points"""


def mbcn_sql(pairs: str, angles, m: int) -> str:
    """The two-variable correction of relation ``pairs``, the future by the historical fit: relation ``corrected``."""
    four = "obs_u IS NOT NULL AND obs_v IS NOT NULL AND sim_u IS NOT NULL AND sim_v IS NOT NULL"
    fill = lambda c, by: f"coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY iy, ix, {by}))"
    ctes = [
        f"good AS (SELECT iy, ix FROM {pairs} GROUP BY 1, 2 HAVING count(*) FILTER (period = 'train_hist' AND {four}) >= 10 AND count(*) FILTER (period = 'test_hist' AND sim_u IS NOT NULL AND sim_v IS NOT NULL) >= 10)",
        f"kept AS (SELECT * FROM {pairs} SEMI JOIN good USING (iy, ix))",
        f"whole AS (SELECT period, time, iy, ix, {fill('sim_u', 'period')} AS u, {fill('sim_v', 'period')} AS v FROM kept)",
        "fit_0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT period, time, iy, ix, '{k}' AS kind, {k}_u AS u, {k}_v AS v FROM kept WHERE period = 'train_hist' AND {four}" for k in ("obs", "sim"))
        + " UNION ALL SELECT period, time, iy, ix, 'sim', u, v FROM whole WHERE period = 'test_hist' AND u IS NOT NULL AND v IS NOT NULL)",
        "new_0 AS MATERIALIZED (SELECT *, CASE WHEN period = 'test_future' THEN 'test_hist' ELSE period END AS fitted FROM whole WHERE u IS NOT NULL AND v IS NOT NULL)",
    ]

    def tables(name: str, rows: str) -> None:
        ctes.append(f"{name}_l AS (SELECT iy, ix, CASE WHEN kind = 'obs' THEN 'obs' ELSE period END AS series, list_sort(list(u)) AS lu, list_sort(list(v)) AS lv, count(*) AS n FROM {rows} GROUP BY ALL)")
        ctes.append(f"{name}_q AS (SELECT iy, ix, series, {nodes_sql('lu', 'n', m)} AS qu, {nodes_sql('lv', 'n', m)} AS qv FROM {name}_l)")
        moved = lambda a: f"list_transform(range(1, {m + 2}), lambda i: p.q{a}[i] + (o.q{a}[i] - h.q{a}[i]))"
        ctes.append(f"{name} AS MATERIALIZED (SELECT p.iy, p.ix, p.series AS fitted, p.qu AS xu, {moved('u')} AS zu, p.qv AS xv, {moved('v')} AS zv FROM {name}_q p JOIN {name}_q o USING (iy, ix) JOIN {name}_q h USING (iy, ix) "
                    "WHERE p.series <> 'obs' AND o.series = 'obs' AND h.series = 'train_hist')")

    mapped = lambda a: interp_sql(a, f"x{a}", f"z{a}", m + 1)
    for i, angle in enumerate(angles):
        c, s = repr(math.cos(angle)) + "::DOUBLE", repr(math.sin(angle)) + "::DOUBLE"
        turn = lambda rel, more: f"(SELECT {more}, u * {c} + v * {s} AS u, v * {c} - u * {s} AS v FROM {rel})"  # noqa: B023, E731
        ctes.append(f"turned_{i} AS MATERIALIZED {turn(f'fit_{i}', 'period, time, iy, ix, kind')}")
        tables(f"t_{i}", f"turned_{i}")
        back = f"u * {c} - v * {s} AS u, v * {c} + u * {s} AS v"
        ctes.append(f"fit_{i + 1} AS MATERIALIZED (SELECT period, time, iy, ix, kind, {back} FROM (SELECT period, time, iy, ix, kind, CASE WHEN kind = 'obs' THEN u ELSE {mapped('u')} END AS u, "
                    f"CASE WHEN kind = 'obs' THEN v ELSE {mapped('v')} END AS v FROM turned_{i} r JOIN t_{i} t USING (iy, ix) WHERE t.fitted = r.period))")
        ctes.append(f"new_{i + 1} AS MATERIALIZED (SELECT period, time, iy, ix, fitted, {back} FROM (SELECT period, time, iy, ix, fitted, {mapped('u')} AS u, {mapped('v')} AS v FROM {turn(f'new_{i}', 'period, time, iy, ix, fitted')} JOIN t_{i} USING (iy, ix, fitted)))")
    tables("t_single", "fit_0")
    place = lambda e: f"row_number() OVER (PARTITION BY iy, ix, period ORDER BY round({e}, 9), time)"
    ctes.append(f"single AS (SELECT period, time, iy, ix, {mapped('u')} AS u, {mapped('v')} AS v FROM new_0 JOIN t_single USING (iy, ix, fitted))")
    ctes.append(f"by_single AS MATERIALIZED (SELECT *, {place('u')} AS ru, {place('v')} AS rv FROM single)")
    ctes.append(f"by_chain AS MATERIALIZED (SELECT period, time, iy, ix, {place('u')} AS ru, {place('v')} AS rv FROM new_{len(angles)})")
    ctes.append("ordered AS (SELECT c.period, c.time, c.iy, c.ix, a.u AS cu, b.v AS cv FROM by_chain c JOIN by_single a ON a.iy = c.iy AND a.ix = c.ix AND a.period = c.period AND a.ru = c.ru "
                "JOIN by_single b ON b.iy = c.iy AND b.ix = c.ix AND b.period = c.period AND b.rv = c.rv)")
    ctes.append(f"corrected AS (SELECT p.*, CASE WHEN sim_u IS NOT NULL AND sim_v IS NOT NULL THEN cu END AS corrected_u, CASE WHEN sim_u IS NOT NULL AND sim_v IS NOT NULL THEN cv END AS corrected_v FROM {pairs} p LEFT JOIN ordered USING (period, time, iy, ix))")
    return ", ".join(ctes)


# Of the query: rotations in radians, the defaults of the operator otherwise.
PAIR_ANGLES = (0.4, 1.1, 1.9, 2.6, 0.8, 2.2)


@query("period:s time:d iy:i ix:i corrected_u:f corrected_v:f", "F4", f"WITH b AS MATERIALIZED ({_PAIRS}), {mbcn_sql('b', PAIR_ANGLES, 50)} SELECT * FROM corrected")
def two_variable_correction(spark, sf):
    return biascorr.mbcn(pair_bundle(spark, sf), angles=PAIR_ANGLES)


_LINES = """lines AS (SELECT iy, ix, regr_slope(obs, raw) AS slope, regr_intercept(obs, raw) AS intercept, regr_r2(obs, raw) AS r2, count(*) AS n FROM daily_points
    WHERE obs IS NOT NULL AND raw IS NOT NULL{0} GROUP BY 1, 2 HAVING count(*) >= 10 AND var_pop(raw) > 1e-9)"""


@query("iy:i ix:i slope:f intercept:f r2:f n:l", "J5", f"WITH {_LINES.format('')} SELECT * FROM lines")
def fit_per_cell(spark, sf):
    points = S.daily_points(spark, sf)
    return cellwise.fit_per_group(points, ["iy", "ix"], cellwise.line_fit("raw", "obs", 10), cellwise.LINE, ["raw", "obs"], order=["time"])


@query("time:d iy:i ix:i corrected:f", "J5", f"WITH {_LINES.format(' AND year(time) <= 1998')} SELECT time, iy, ix, slope * raw + intercept AS corrected FROM daily_points LEFT JOIN lines USING (iy, ix) WHERE year(time) > 1998")
def fit_and_predict_per_cell(spark, sf):
    points, year = S.daily_points(spark, sf), F.year("time")
    fitted = cellwise.fit_per_group(points.where(year <= 1998), ["iy", "ix"], cellwise.line_fit("raw", "obs", 10), cellwise.LINE, ["raw", "obs"], order=["time"])
    return cellwise.predict_per_group(
        materialise(fitted, "lines"), points.where(year > 1998), ["iy", "ix"], cellwise.line_predict("raw", ["time"], "corrected"), "time timestamp, corrected double", ["time", "raw"])


def _psi(x: str, tri: bool = False) -> str:
    y = f"({x} + 6.0)"
    if tri:
        lift = " + ".join([f"1.0 / ({x} * {x})"] + [f"1.0 / (({x} + {i}.0) * ({x} + {i}.0))" for i in range(1, 6)])
        return f"({lift} + 1.0 / {y} + 1.0 / ({y} * {y}) / 2.0 + 1.0 / ({y} * {y}) / {y} * (1 / 6 - 1.0 / ({y} * {y}) * (1 / 30 - 1.0 / ({y} * {y}) * (1 / 42 - 1.0 / ({y} * {y}) * (1 / 30)))))"
    lift = " + ".join([f"1.0 / {x}"] + [f"1.0 / ({x} + {i}.0)" for i in range(1, 6)])
    return f"(ln({y}) - 0.5 / {y} - 1.0 / ({y} * {y}) * (1 / 12 - 1.0 / ({y} * {y}) * (1 / 120 - 1.0 / ({y} * {y}) * (1 / 252 - 1.0 / ({y} * {y}) * (1 / 240)))) - ({lift}))"


def gamma_sql(rel: str, keys: str) -> str:
    """Gamma fits of relation (keys, value) for values above 1: relation ``gfit``."""
    steps = "".join(f", g{i} AS (SELECT * REPLACE (a - (ln(a) - {_psi('a')} - s) / (1.0 / a - {_psi('a', True)}) AS a) FROM g{i - 1})" for i in range(1, 5))
    return f"""gs AS (SELECT {keys}, avg(value) FILTER (value > 1) AS m, avg(CASE WHEN value > 1 THEN ln(value) END) AS l, count(*) FILTER (value > 1) AS n_wet FROM {rel} GROUP BY ALL), gg AS (SELECT *, CASE WHEN ln(m) - l > 1e-12 THEN ln(m) - l END AS s FROM gs),
    g0 AS (SELECT *, (3.0 - s + sqrt((s - 3.0) * (s - 3.0) + 24.0 * s)) / (12.0 * s) AS a FROM gg){steps}, gfit AS (SELECT {keys}, n_wet, a AS alpha, a / m AS beta FROM g4)"""


def amounts(spark, sf):
    return S.line_rows(spark, sf).groupBy("time", "iy", "ix").agg(F.avg(F.col("l_extendedprice") / 30000).alias("value"))


_AMOUNTS = "SELECT time, iy, ix, avg(l_extendedprice / 30000) AS value FROM line_rows GROUP BY 1, 2, 3"


@query("year:i iy:i ix:i n_wet:l alpha:f beta:f", "F5", f"WITH a AS (SELECT year(time) AS year, iy, ix, value FROM ({_AMOUNTS})), {gamma_sql('a', 'year, iy, ix')} SELECT * FROM gfit")
def gamma_fit(spark, sf):
    return biascorr.gamma_fit(amounts(spark, sf).withColumn("year", F.year("time")), ["year", "iy", "ix"])


def _repair_sql(rel: str, v: str, keys: str = "year") -> str:
    return f"""(SELECT f.* REPLACE (CASE WHEN {v} > lim THEN (SELECT avg(n.{v}) FROM {rel} n WHERE n.{keys} = f.{keys} AND abs(n.iy - f.iy) <= 1 AND abs(n.ix - f.ix) <= 1) ELSE {v} END AS {v})
      FROM {rel} f, (SELECT 8 * stddev_pop({v}) FILTER ({v} > 0) AS lim FROM {rel}))"""


@query("iy:i ix:i alpha:f beta:f", "F5 E6", f"WITH a AS (SELECT year(time) AS year, iy, ix, value FROM ({_AMOUNTS})), {gamma_sql('a', 'year, iy, ix')}, r1 AS {_repair_sql('gfit', 'alpha')}, r2 AS {_repair_sql('r1', 'beta')} SELECT iy, ix, avg(alpha) AS alpha, avg(beta) AS beta FROM r2 GROUP BY 1, 2")
def gamma_parameters(spark, sf):
    return biascorr.gamma_parameters(amounts(spark, sf))


@query("time:d iy:i ix:i value:f", "E6", """
    WITH f AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, max(l_extendedprice) AS value FROM line_rows GROUP BY 1, 2, 3)
    SELECT time, iy, ix, CASE WHEN value > 90000 THEN (SELECT avg(n.value) FROM f n WHERE n.time = f.time AND abs(n.iy - f.iy) <= 1 AND abs(n.ix - f.ix) <= 1) ELSE value END AS value FROM f""")
def aberrant_repair(spark, sf):
    f = S.line_rows(spark, sf).groupBy(F.date_trunc("month", "time").alias("time"), "iy", "ix").agg(F.max("l_extendedprice").alias("value"))
    return biascorr.repair_aberrant(f, "value", threshold=90000.0)


@query("time:d iy:i ix:i filled:f", "E10", "SELECT time, iy, ix, CASE WHEN count(obs) OVER w >= 10 THEN coalesce(obs, quantile_cont(obs, 0.5) OVER w) END AS filled FROM daily_points WINDOW w AS (PARTITION BY iy, ix)")
def median_gap_fill(spark, sf):
    return biascorr.median_fill(S.daily_points(spark, sf), "obs")


@query("unmatched:l obs_rows:l sim_rows:l", "F6", "SELECT count(*) FILTER (obs IS NULL) AS unmatched, count(obs) AS obs_rows, count(*) AS sim_rows FROM daily_points")
def training_shapes(spark, sf):
    p = S.daily_points(spark, sf)
    return biascorr.training_mismatch(p.where("obs is not null"), p)


@query("time:d iy:i ix:i p:f", "J5", f"SELECT time, iy, ix, 1 - exp(-value / 2) * (1 + value / 2) AS p FROM ({_AMOUNTS})")
def gamma_cdf_by_name(spark, sf):
    gamma.register(spark)
    # Shape 2 has a closed form to compare with.
    return amounts(spark, sf).selectExpr("time", "iy", "ix", "gamma_cdf(value, 2D, 0.5D) AS p")


_GAMMA_TERMS = 400  # enough for the shapes and values of these tables


@query("period:s gamma_mae:f", "D35", f"""
    WITH am AS ({_AMOUNTS}), a AS (SELECT year(time) AS year, iy, ix, value FROM am), {gamma_sql('a', 'year, iy, ix')}, r1 AS {_repair_sql('gfit', 'alpha')}, r2 AS {_repair_sql('r1', 'beta')},
    par AS (SELECT iy, ix, coalesce(avg(alpha), 1) AS a, coalesce(avg(beta), 1) AS b FROM r2 GROUP BY 1, 2),
    s AS (SELECT period, value AS y, value * raw / coalesce(obs, raw) AS p, a, value * b AS x FROM am JOIN period_points USING (time, iy, ix) JOIN par USING (iy, ix)),
    c AS (SELECT *, exp(a * ln(x) - x - lgamma(a + 1)) * list_sum(list_transform(range(0, {_GAMMA_TERMS}), lambda n: exp(n * ln(x) - lgamma(a + n + 1) + lgamma(a + 1)))) AS f FROM s)
    SELECT period, avg(abs(y - p) + f * f * greatest(0, y - p)) AS gamma_mae FROM c GROUP BY 1""")
def gamma_weighted_mae(spark, sf):
    a = amounts(spark, sf)
    scored = a.join(S.daily_points(spark, sf), ["time", "iy", "ix"]).select("time", "iy", "ix", F.col("value").alias("y"), (F.col("value") * F.col("raw") / F.coalesce("obs", "raw")).alias("pred"))
    parameters = biascorr.gamma_parameters(a)
    return biascorr.gamma_weighted_mae(timeops.tag_windows(scored, S.PERIODS, name="period"), parameters, ["period"])


# --- scoring -------------------------------------------------------------------------------------------

def last_channel(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The simplest model: hands the last input channel through."""
    return x[:, -1]


def jittered(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A stochastic model: the last channel plus noise that is arithmetic in the seed and the place, so SQL can follow."""
    place = np.arange(x.shape[2])[:, None] * 5 + np.arange(x.shape[3])[None, :] * 3
    return x[:, -1] + ((seed.reshape(-1, 1, 1) * 7 + place) % 11 - 5) / 100.0


def scoring_inputs(spark, sf):
    rows = tile_samples(spark, sf)
    stats = normalise.channel_statistics(rows.where("role = 'x'"))
    mask = rows.where("role = 'y' and value is not null").select("iy", "ix").distinct()
    return rows, dict(channels=CHANNELS, stats=stats, target_channel="raw input", mask=mask, ny=S.NY, nx=S.NX)


_FILLED = """d AS (SELECT DISTINCT time FROM tile_points), c AS (SELECT DISTINCT iy, ix FROM tile_points WHERE obs IS NOT NULL), lo AS (SELECT min(raw::FLOAT)::DOUBLE AS m, max(raw::FLOAT)::DOUBLE AS top FROM tile_points),
    every AS (SELECT d.time, c.iy, c.ix, raw, obs, m, top, coalesce(((raw::FLOAT::DOUBLE - m) / (top - m))::FLOAT::DOUBLE, 0) * (top - m) + m AS filled FROM c JOIN d ON true JOIN lo ON true LEFT JOIN tile_points p ON p.time = d.time AND p.iy = c.iy AND p.ix = c.ix)"""
_RIM = geometry.pad_offset(S.NY)


@query("time:d iy:i ix:i value:g", "J1", f"WITH {_FILLED} SELECT time, iy, ix, filled AS value FROM every")
def field_scoring(spark, sf):
    rows, settings = scoring_inputs(spark, sf)
    return scoring.score_fields(rows, last_channel, **settings)


@query("time:d iy:i ix:i value:g", "J2", f"""
    WITH {_FILLED}, draws AS (SELECT *, date_diff('day', DATE '1970-01-01', time::DATE) * 4 + draw AS seed FROM every, range(1, 5) r(draw))
    SELECT time, iy, ix, avg(filled + ((seed * 7 + (iy + {_RIM}) * 5 + (ix + {_RIM}) * 3) % 11 - 5) / 100.0 * (top - m)) AS value FROM draws GROUP BY 1, 2, 3""")
def ensemble_scoring(spark, sf):
    rows, settings = scoring_inputs(spark, sf)
    seed_of = lambda time, draw: F.unix_date(F.to_date(time)) * 4 + draw
    return scoring.score_fields(rows, jittered, draws=4, seed_of=seed_of, **settings)


@query("time:d iy:i ix:i input:g target:g prediction:g error:g", "J3", f"""
    WITH {_FILLED} SELECT time, iy, ix, raw AS input, obs AS target, filled AS prediction, filled - obs AS error FROM every WHERE time::DATE = '1998-07-15'""")
def single_date_scoring(spark, sf):
    rows, settings = scoring_inputs(spark, sf)
    return scoring.score_date(rows, "1998-07-15", model=last_channel, **settings)


@query("time:d iy:i ix:i value:f", "J4", "SELECT t.time, iy, ix, NULL::DOUBLE AS value FROM (SELECT DISTINCT l_shipdate AS time FROM lineitem) t, (SELECT DISTINCT iy, ix FROM grid_cells) g")
def prediction_template(spark, sf):
    return samples.prediction_template(S.line_rows(spark, sf).select("time"), S.grid(spark, sf))


# --- streams -------------------------------------------------------------------------------------------

_SUMS = """SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS m, l_returnflag AS run, abs(l_quantity * (l_tax - l_discount)) AS d FROM lineitem"""


def difference_rows(table):
    q = F.col("l_quantity")
    return table.select(F.col("l_shipdate").alias("time"), F.col("l_returnflag").alias("run"), (q * (1 + F.col("l_tax") - F.col("l_discount"))).alias("a"), q.alias("b"))


@query("window_start:d run:s n:l sum_abs:f sum_sq:f max_abs:f", "I1", """
    SELECT l_shipdate AS window_start, l_returnflag AS run, count(*) AS n, sum(d) AS sum_abs, sum(d * d) AS sum_sq, max(d) AS max_abs FROM (SELECT *, abs(l_quantity * (1 + l_tax - l_discount) - l_quantity) AS d FROM lineitem) GROUP BY 1, 2""")
def streaming_skill(spark, sf):
    source = S.table(spark, sf, "lineitem")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "lineitem.parquet*").parquet(sf)
    path = new_path(spark, "stream-sums")
    skill_stream.start_skill_stream(difference_rows(stream), path).awaitTermination()
    return skill_stream.latest_sums(spark, path)


@query("run:s count:l mean_abs_diff:f rmse:f max_abs_diff:f", "I2 I1", """
    SELECT l_returnflag AS run, count(*) AS count, avg(d) AS mean_abs_diff, sqrt(avg(d * d)) AS rmse, max(d) AS max_abs_diff FROM (SELECT l_returnflag, abs(l_quantity * (1 + l_tax - l_discount) - l_quantity) AS d FROM lineitem) GROUP BY 1""")
def merged_partial_skill(spark, sf):
    rows = difference_rows(S.table(spark, sf, "lineitem"))
    chunks = [skill_stream.difference_sums(timeops.filter_dates(rows, a, b)) for a, b in ((None, "1997-12-31"), ("1998-01-01", "1999-12-31"), ("2000-01-01", None))]
    return skill_stream.skill_from_sums(chunks[0].unionByName(chunks[1]).unionByName(chunks[2]))


# --- composite jobs ------------------------------------------------------------------------------------

@query("time:d iy:i ix:i lon:f lat:f value:f mask:i", "P1", """
    WITH h AS (SELECT avg(height) AS h FROM grid_cells), f AS (SELECT time, iy, ix, CASE WHEN height < 0 THEN NULL ELSE obs + (h - height) * -0.0065 END AS value, lon, lat FROM daily_points JOIN grid_cells USING (iy, ix), h WHERE lon BETWEEN 36 AND 252 AND lat BETWEEN 8 AND 22),
    m AS (SELECT time, avg(value) AS m FROM f GROUP BY 1) SELECT time, iy, ix, lon, lat, CASE WHEN m < 100 THEN value + 273.15 ELSE value END AS value, (value IS NOT NULL)::INT AS mask FROM f JOIN m USING (time)""")
def source_reader(spark, sf):
    g = S.grid(spark, sf)
    field = S.observed(spark, sf).withColumns({"source": F.lit("reanalysis"), "variable": F.lit("tas")})
    smooth = g.select("iy", "ix", g.agg(F.avg("height").alias("h")).scalar().alias("height"))
    mask = g.select("iy", "ix", (F.col("height") >= 0).cast("double").alias("mask_value"))
    return composites.read_source(field, g, (36.0, 252.0, 8.0, 22.0), "era5", mask, "era5", g.select("iy", "ix", "height"), smooth)


def source_catalog(spark, sf):
    """Four sources twice a day: a reanalysis and observations, a model and a regional model with two scenarios."""
    # One pass over the points; each becomes the rows of all sources that have its day.
    def part(source, variable, scenario, value, where=True):
        row = F.struct(F.lit(source).alias("source"), F.lit(variable).alias("variable"), F.lit(scenario).alias("scenario"), value.alias("value"))
        return F.when(F.lit(where) if where is True else F.coalesce(F.expr(where), F.lit(False)), row)

    parts = [part("reanalysis_a", "tas", "historical", F.col("raw") + 250), part("station_a", "tas", "historical", F.col("obs"))]
    for name, variable, value in (("model_a", "tas", F.col("ml") + 240), ("regional_a", "pr", (F.col("bc") - 20) / 86400)):
        parts += [part(name, variable, "historical", value, "time < '1999-06-01'"), part(name, variable, "ssp585", value + 1, "time >= '1998-01-01'")]
    points = S.daily_points(spark, sf).sortWithinPartitions("time")
    rows = points.select("time", "iy", "ix", F.explode(F.array_compact(F.array(*parts))).alias("_r")).select("time", "iy", "ix", "_r.*")
    hours = F.explode(F.array(F.lit(0), F.lit(12))).alias("h")
    at = F.col("time").cast("timestamp") + F.make_dt_interval(hours=F.col("h"))
    out = rows.select("*", hours).select("source", "variable", "scenario", F.lit("r1").alias("member"), at.alias("time"), "iy", "ix", (F.col("value") + F.col("h") / 12).alias("value"))
    root = new_path(spark, "sources")
    catalog.write_field(out, root, in_order=True)
    return catalog.open_catalog(spark, root)


SOURCES = {s.name: s for s in (
    readers.Source("reanalysis_a", "reanalysis", "latlon", "era5"), readers.Source("model_a", "model", "gcm", "gcm"),
    readers.Source("regional_a", "model", "rcm", "rcm"), readers.Source("station_a", "observation", "eobs", "eobs", "eobs"),
)}
_DOMAIN = (-110.0, 75.0, 6.0, 22.0)
_DEGREES = "deg AS (SELECT iy, ix, (lon + 180) % 360 - 180 AS lon, lat, height FROM grid_cells)"
_INSIDE = "lon BETWEEN -110 AND 75 AND lat BETWEEN 6 AND 22"


def _kelvin(rows: str) -> str:
    return f"SELECT r.* REPLACE (CASE WHEN m < 100 THEN value + 273.15 ELSE value END AS value) FROM ({rows}) r JOIN (SELECT time, avg(value) AS m FROM ({rows}) GROUP BY 1) USING (time)"


_REANALYSIS = f"SELECT time, iy, ix, lon, lat, raw + 250.5 + (100 - coalesce(height, 0)) * -0.0065 AS value FROM daily_points JOIN deg USING (iy, ix) WHERE {_INSIDE} AND time >= '1996-02-01' AND time < '1999-02-01'"
_MODEL = f"SELECT time, iy, ix, lon, lat, ml + 240.5 + CASE WHEN time >= '1999-01-01' THEN 1 ELSE 0 END AS value FROM daily_points JOIN deg USING (iy, ix) WHERE {_INSIDE} AND time >= '1997-02-01' AND time < '2000-02-01'"
_STATION = f"SELECT time, iy, ix, lon, lat, CASE WHEN height > 0 THEN NULL ELSE obs + 0.5 END AS value FROM daily_points JOIN deg USING (iy, ix) WHERE {_INSIDE} AND time >= '1996-02-01' AND time < '1999-02-01'"


def native_grid(spark, sf):
    """Spelled as such files spell it, longitudes from 0 to 360."""
    return S.grid(spark, sf).select("iy", "ix", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))


@query("time:d iy:i ix:i lon:f lat:f value:f", "P1", f"WITH {_DEGREES} {_kelvin(_REANALYSIS)}")
def read_reanalysis(spark, sf):
    own = S.grid(spark, sf).select("iy", "ix", "height")
    heights = (own, own.select("iy", "ix", F.lit(100.0).alias("height")), None, None)
    return readers.read(source_catalog(spark, sf), SOURCES["reanalysis_a"], native_grid(spark, sf), "tas", "1996-02-01", "1999-01-31", _DOMAIN, heights=heights)


@query("time:d iy:i ix:i lon:f lat:f value:f", "P1", f"WITH {_DEGREES} {_kelvin(_MODEL)}")
def read_model(spark, sf):
    return readers.read(source_catalog(spark, sf), SOURCES["model_a"], native_grid(spark, sf), "tas", "1997-02-01", "2000-01-31", _DOMAIN, split="1999-01-01")


@query("time:d iy:i ix:i x:f y:f value:f", "P1", """
    SELECT time, iy, ix, (ix * 12.5 - 50) * 1000 AS x, (iy * 12.5 + 25) * 1000 AS y, greatest((bc - 20) / 86400 + 0.5 + CASE WHEN time >= '1999-01-01' THEN 1 ELSE 0 END, 0) * 86400 AS value
    FROM daily_points WHERE time >= '1998-11-01' AND time < '1999-04-01'""")
def read_regional(spark, sf):
    grid = S.grid(spark, sf).select("iy", "ix", (F.col("ix") * 12.5 - 50).alias("i"), (F.col("iy") * 12.5 + 25).alias("j"))
    return readers.read(source_catalog(spark, sf), SOURCES["regional_a"], grid, "pr", "1998-11-01", "1999-03-31", split="1999-01-01")


@query("time:d iy:i ix:i lon:f lat:f value:f", "P1", f"WITH {_DEGREES} {_kelvin(_STATION)}")
def read_observation(spark, sf):
    mask = S.grid(spark, sf).select("iy", "ix", (F.col("height") > 0).cast("double").alias("mask_value"))
    return readers.read(source_catalog(spark, sf), SOURCES["station_a"], native_grid(spark, sf), "tas", "1996-02-01", "1999-01-31", _DOMAIN, mask=mask)


_FINE = "fine AS (SELECT src_iy AS dst_iy, src_ix AS dst_ix, dst_iy AS src_iy, dst_ix AS src_ix, w / sum(w) OVER (PARTITION BY src_iy, src_ix) AS w FROM weights WHERE w > 0)"
_BRIDGE = f"{_FINE}, bridge AS (SELECT a.src_iy, a.src_ix, b.dst_iy, b.dst_ix, sum(a.w * b.w) AS w FROM weights a JOIN fine b ON a.dst_iy = b.src_iy AND a.dst_ix = b.src_ix WHERE a.w > 0 GROUP BY 1, 2, 3, 4)"


def bridge(spark, sf):
    first = conservative_weights(S.grid(spark, sf), coarse_grid(spark, sf))
    totals = first.groupBy("src_iy", "src_ix").agg(F.sum("w").alias("t"))
    second = first.join(totals, ["src_iy", "src_ix"]).select(F.col("dst_iy").alias("src_iy"), F.col("dst_ix").alias("src_ix"), F.col("src_iy").alias("dst_iy"), F.col("src_ix").alias("dst_ix"), (F.col("w") / F.col("t")).alias("w"))
    return chain_weights(first, second)


def _renorm(rel: str, weights: str, v: str = "value") -> str:
    return f"SELECT time, dst_iy AS iy, dst_ix AS ix, sum(w * {v}) / sum(w) FILTER ({v} IS NOT NULL) AS value FROM {weights} JOIN {rel} src ON src.iy = src_iy AND src.ix = src_ix WHERE w > 0 GROUP BY 1, 2, 3"


@query("time:d role:s channel:s iy:i ix:i value:g", "P2 A7", f"""WITH {_CONSERVATIVE}, {_BRIDGE}, r AS ({_renorm('daily_points', 'bridge', 'raw')}), k AS (SELECT r.*, obs FROM r LEFT JOIN daily_points USING (time, iy, ix))
    SELECT time, 'x' AS role, 'raw input' AS channel, iy, ix, CASE WHEN obs IS NOT NULL THEN value::FLOAT END AS value FROM k UNION ALL SELECT time, 'y', 'target', iy, ix, obs::FLOAT FROM daily_points
    UNION ALL SELECT time, 'x', 'elevation', iy, ix, CASE WHEN obs IS NOT NULL THEN height::FLOAT END FROM k JOIN grid_cells USING (iy, ix)""")
def training_sample_build(spark, sf):
    p = materialise(S.daily_points(spark, sf).select("time", "iy", "ix", "obs", "raw"), "points")
    field = lambda c: p.select("time", "iy", "ix", F.col(c).alias("value"))
    static = S.grid(spark, sf).select("iy", "ix", F.col("height").alias("value"))
    built = composites.training_samples(field("obs"), static, {"raw input": field("raw")}, bridge(spark, sf))
    return composites.write_and_read(built, new_path(spark, "training"))


@query("time:d role:s channel:s iy:i ix:i value:g", "P3 A7", f"""WITH {_CONSERVATIVE}, d AS (SELECT time, iy, ix, raw AS value, bc FROM daily_points), r AS ({_renorm('d', 'weights')}), b AS ({_renorm('d', 'weights', 'bc')}), o AS ({_renorm('daily_points', 'weights', 'obs')})
    SELECT time, 'x' AS role, 'raw input' AS channel, iy, ix, value::FLOAT AS value FROM r UNION ALL SELECT time, 'x', 'raw input corrected', iy, ix, value::FLOAT FROM b UNION ALL SELECT time, 'y', 'target', iy, ix, value::FLOAT FROM o WHERE time < '1999-01-01'
    UNION ALL SELECT time, 'x', 'elevation', iy, ix, (iy * 100.0 + ix)::FLOAT FROM r""")
def simulation_sample_build(spark, sf):
    p = S.daily_points(spark, sf)
    field = lambda c: p.select("time", "iy", "ix", F.col(c).alias("value"))
    coarse = coarse_grid(spark, sf)
    weights = conservative_weights(S.grid(spark, sf), coarse)
    target = regrid(field("obs"), weights, renormalise=True)
    static = coarse.select("iy", "ix", (F.col("iy") * 100.0 + F.col("ix")).alias("value"))
    built = composites.simulation_samples(field("raw"), "daily", "daily", weights, static, "raw input", target, field("bc"), "1998-12-31")
    return composites.write_and_read(built, new_path(spark, "simulation"))


@query("period:s time:d iy:i ix:i obs:f sim:f", "P4", f"""WITH {_CONSERVATIVE}, {_BRIDGE}, o AS ({_renorm('monthly_points', 'bridge', 'obs')}), m AS (SELECT CASE WHEN year(time) <= 1998 THEN 'train_hist' WHEN year(time) <= 2000 THEN 'test_hist' ELSE 'test_future' END AS period, time, iy, ix, raw FROM monthly_points)
    SELECT period, time, iy, ix, CASE WHEN period <> 'test_future' THEN value END AS obs, raw AS sim FROM m LEFT JOIN o USING (time, iy, ix)""")
def correction_bundle_build(spark, sf):
    m = S.monthly_points(spark, sf)
    field = lambda c: m.select("time", "iy", "ix", F.col(c).alias("value"))
    return composites.correction_bundle(field("raw"), field("obs"), bridge(spark, sf), S.PERIODS)


@query("period:s time:d role:s channel:s iy:i ix:i value:g", "P5 A7", f"""WITH b AS ({_BUNDLE}), {cdft_sql('b', 'b', 100)}, {_CONSERVATIVE}, r AS ({_renorm('corrected', 'weights', 'corrected')}), truth AS ({_renorm('daily_points', 'weights', 'ml')}),
    spans AS (SELECT DISTINCT time, period FROM b) SELECT period, time, role, channel, iy, ix, value FROM (
    SELECT time, 'x' AS role, 'tas input' AS channel, iy, ix, value::FLOAT AS value FROM r UNION ALL SELECT time, 'x', 'elevation', iy, ix, (iy * 100.0 + ix)::FLOAT FROM r UNION ALL SELECT time, 'y', 'target', iy, ix, value::FLOAT FROM truth) JOIN spans USING (time)""")
def corrected_sample_build(spark, sf):
    coarse = coarse_grid(spark, sf)
    weights = conservative_weights(S.grid(spark, sf), coarse)
    static = coarse.select("iy", "ix", (F.col("iy") * 100.0 + F.col("ix")).alias("value"))
    truth = regrid(S.daily_points(spark, sf).select("time", "iy", "ix", F.col("ml").alias("value")), weights, renormalise=True)
    built = composites.corrected_samples(bundle(spark, sf), weights, static, "tas input", pseudo_truth=truth)
    return composites.write_and_read(built, new_path(spark, "corrected"))


@query("iy:i ix:i elevation:f n:l mean:f", "P6", f"""WITH {_COARSE}, e AS (SELECT coarse.iy AS iy, coarse.ix AS ix, (coarse.lon * 3 + coarse.lat * 5) * 9.80665 AS z FROM coarse), t AS (SELECT iy, ix, count(obs) AS n, avg(obs) AS mean FROM daily_points GROUP BY 1, 2)
    SELECT iy, ix, least(greatest(lon, (SELECT min(lon) FROM coarse)), (SELECT max(lon) FROM coarse)) * 3 + least(greatest(lat, (SELECT min(lat) FROM coarse)), (SELECT max(lat) FROM coarse)) * 5 AS elevation, n, mean
    FROM grid_cells JOIN t USING (iy, ix) WHERE lon BETWEEN 36 AND 252 AND lat BETWEEN 8 AND 22""")
def target_preparation(spark, sf):
    # A geopotential linear in lon and lat, which bilinear interpolation reproduces exactly.
    coarse = coarse_grid(spark, sf)
    z = coarse.select("iy", "ix", ((F.col("lon") * 3 + F.col("lat") * 5) * 9.80665).alias("value"))
    target, elevation = composites.prepare_target(S.observed(spark, sf), S.grid(spark, sf), z, coarse, (36.0, 252.0, 8.0, 22.0))
    means = target.groupBy("iy", "ix").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return means.join(elevation.withColumnRenamed("value", "elevation"), ["iy", "ix"])


@query("block:s window:s method:s metric:s value:f", "P7", " UNION ALL ".join(f"""
    SELECT 'skill' AS block, '{w}' AS "window", method, 'rmse' AS metric, sqrt(avg((pred - obs) * (pred - obs))) AS value FROM method_points WHERE time::DATE BETWEEN '{a}' AND '{b}' GROUP BY method
    UNION ALL SELECT 'window_statistics', '{w}', method, 'mean_bias', avg(pred - obs) FROM method_points WHERE time::DATE BETWEEN '{a}' AND '{b}' GROUP BY method
    UNION ALL SELECT 'densities', '{w}', method, 'n', count(*) FROM method_points WHERE time::DATE BETWEEN '{a}' AND '{b}' GROUP BY method""" for w, a, b in S.WINDOWS) + f"""
    UNION ALL SELECT 'signal', 'change', method, 'corr', {corr_sql('c', 't')} FROM (SELECT method, iy, ix, avg(pred) FILTER (year(time) >= 2000) - avg(pred) FILTER (year(time) <= 1997) AS c, avg(obs) FILTER (year(time) >= 2000) - avg(obs) FILTER (year(time) <= 1997) AS t FROM method_points GROUP BY 1, 2, 3) GROUP BY method""")
def model_evaluation(spark, sf):
    parts = composites.model_evaluation(S.method_pairs(spark, sf), S.WINDOWS, ("1995-01-01", "1997-12-31"), ("2000-01-01", "2001-12-31"))

    def long(name, metric, column, window="window"):
        w = F.col("window") if window == "window" else F.lit(window)
        return parts[name].select(F.lit(name).alias("block"), w.alias("window"), "method", F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))

    counts = parts["densities"].groupBy("window", "method").agg(F.sum("n").alias("n"))
    density = counts.select(F.lit("densities").alias("block"), "window", "method", F.lit("n").alias("metric"), F.col("n").cast("double").alias("value"))
    return long("skill", "rmse", "rmse").unionByName(long("window_statistics", "mean_bias", "mean_bias")).unionByName(density).unionByName(long("signal", "corr", "corr", "change"))
