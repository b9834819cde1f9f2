"""Comparison tables, ordered operators, set operations and checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import align, compare, quality, skill, timeops
from gridloom.operators.ordering import calendar_bucket, positions
from gridloom.plans import standins as S
from gridloom.plans.queries_skill import SUMMARY, corr_sql, summary_sql, value_sql
from gridloom.plans.registry import query


@query("time:d iy:i ix:i only_in:s", "C9", """
    SELECT time, iy, ix, CASE WHEN u.k IS NULL THEN 'second' ELSE 'first' END AS only_in FROM (SELECT time, iy, ix, 1 AS k FROM daily_points WHERE obs > 10) u
    FULL JOIN (SELECT time, iy, ix, 1 AS k FROM daily_points WHERE raw > 10) v USING (time, iy, ix) WHERE u.k IS NULL OR v.k IS NULL""")
def component_mismatch(spark, sf):
    p = S.daily_points(spark, sf)
    return align.component_mismatch(p.where("obs > 10"), p.where("raw > 10"))


@query("period:s time:d iy:i ix:i sfcWind:f windFromDir:f", "H3 C9", """
    SELECT period, time, iy, ix, sqrt((raw - 25) * (raw - 25) + (ml - 24) * (ml - 24)) AS "sfcWind", ((270 - degrees(atan2(ml - 24, raw - 25))) % 360 + 360) % 360 AS "windFromDir" FROM period_points""")
def wind_products(spark, sf):
    p = S.period_points(spark, sf)
    on = ("period", "time", "iy", "ix")
    both = align.join_components(p.select(*on, (F.col("raw") - 25).alias("uas")), p.select(*on, (F.col("ml") - 24).alias("vas")), on)
    return align.wind_products(both)


@query("expected_count:l actual_count:l missing_count:l extra_count:l missing_head:s extra_head:s status:s", "C10 G3", """
    WITH e AS (SELECT DISTINCT strftime(o_orderdate, 'sample_%Y%m%d') AS k FROM orders), a AS (SELECT DISTINCT strftime(l_shipdate, 'sample_%Y%m%d') AS k FROM lineitem),
    m AS (SELECT k FROM e EXCEPT SELECT k FROM a), x AS (SELECT k FROM a EXCEPT SELECT k FROM e)
    SELECT (SELECT count(*) FROM e) AS expected_count, (SELECT count(*) FROM a) AS actual_count, (SELECT count(*) FROM m) AS missing_count, (SELECT count(*) FROM x) AS extra_count,
    (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM m ORDER BY k LIMIT 5)) AS missing_head, (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT k FROM x ORDER BY k LIMIT 5)) AS extra_head,
    CASE WHEN (SELECT count(*) FROM m) + (SELECT count(*) FROM x) = 0 THEN 'ok' ELSE 'fail' END AS status""")
def inventory_diff(spark, sf):
    name = lambda c: F.concat(F.lit("sample_"), F.date_format(c, "yyyyMMdd")).alias("k")
    return align.inventory_diff(S.table(spark, sf, "orders").select(name("o_orderdate")), S.table(spark, sf, "lineitem").select(name("l_shipdate")), "k")


_RUNS = """WITH b AS (SELECT l_returnflag AS flag, year(time) AS year, avg(obs) AS mean, stddev_pop(obs) AS std FROM line_rows WHERE year(time) <= 2000 GROUP BY 1, 2),
    c AS (SELECT l_returnflag AS flag, year(time) AS year, avg(raw) AS mean, stddev_pop(raw) AS std FROM line_rows WHERE year(time) >= 1996 GROUP BY 1, 2),
    bl AS (SELECT flag, year, 'mean' AS metric, mean AS x FROM b UNION ALL SELECT flag, year, 'std', std FROM b), cl AS (SELECT flag, year, 'mean' AS metric, mean AS x FROM c UNION ALL SELECT flag, year, 'std', std FROM c)"""


@query("flag:s year:i metric:s baseline:f candidate:f delta:f status:s", "C11", _RUNS + """
    SELECT flag, year, metric, bl.x AS baseline, cl.x AS candidate, cl.x - bl.x AS delta, CASE WHEN bl.flag IS NULL THEN 'missing_baseline' WHEN cl.flag IS NULL THEN 'missing_candidate' ELSE 'ok' END AS status
    FROM bl FULL JOIN cl USING (flag, year, metric)""")
def run_delta(spark, sf):
    rows = S.line_rows(spark, sf)

    def table(value, keep):
        return rows.where(keep).groupBy(F.col("l_returnflag").alias("flag"), F.year("time").alias("year")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))

    return align.run_delta(table("obs", F.year("time") <= 2000), table("raw", F.year("time") >= 1996), ["flag", "year"], ["mean", "std"])


@query("artifact:s key:s status:s mean_abs_diff:f rmse:f max_abs_diff:f candidate_mean:f archive_mean:f candidate_std:f archive_std:f exact_match:i", "C12", """
    WITH c AS (SELECT period AS artifact, key, time, iy, ix, value, text FROM (SELECT period, 'sim' AS key, time, iy, ix, raw AS value, NULL AS text FROM period_points UNION ALL SELECT period, 'obs', time, iy, ix, obs, NULL FROM period_points
      UNION ALL SELECT period, 'dates', time, iy, ix, NULL, strftime(time, '%Y-%m-%d') FROM period_points)),
    a AS (SELECT period AS artifact, key, time, iy, ix, value, text FROM (SELECT period, 'sim' AS key, time, iy, ix, bc AS value, NULL AS text FROM period_points UNION ALL SELECT period, 'obs', time, iy, ix, obs, NULL FROM period_points WHERE obs > 5 AND period <> 'test_future'
      UNION ALL SELECT period, 'dates', time, iy, ix, NULL, strftime(time, '%Y-%m-%d') FROM period_points)),
    j AS (SELECT artifact, key, c.value AS cv, a.value AS av, c.text AS ct, a.text AS at_, c.iy AS ci, a.iy AS ai FROM c FULL JOIN a USING (artifact, key, time, iy, ix)),
    s AS (SELECT artifact, key, count(ci) AS nc, count(ai) AS na, count(*) AS n, avg(abs(cv - av)) AS mad, sqrt(avg((cv - av) * (cv - av))) AS rmse, max(abs(cv - av)) AS mx, avg(cv) AS cm, avg(av) AS am, stddev_pop(cv) AS cs, stddev_pop(av) AS ast, bool_and(ct IS NOT DISTINCT FROM at_) AS same FROM j GROUP BY 1, 2),
    t AS (SELECT *, CASE WHEN nc = 0 OR na = 0 THEN 'missing_key' WHEN nc <> n OR na <> n THEN 'shape_mismatch' ELSE 'ok' END AS status FROM s)
    SELECT artifact, key, status, CASE WHEN status = 'ok' AND key <> 'dates' THEN mad END AS mean_abs_diff, CASE WHEN status = 'ok' AND key <> 'dates' THEN rmse END AS rmse, CASE WHEN status = 'ok' AND key <> 'dates' THEN mx END AS max_abs_diff,
    CASE WHEN status = 'ok' AND key <> 'dates' THEN cm END AS candidate_mean, CASE WHEN status = 'ok' AND key <> 'dates' THEN am END AS archive_mean, CASE WHEN status = 'ok' AND key <> 'dates' THEN cs END AS candidate_std, CASE WHEN status = 'ok' AND key <> 'dates' THEN ast END AS archive_std,
    CASE WHEN status = 'ok' AND key = 'dates' THEN CAST(same AS INTEGER) END AS exact_match FROM t""")
def archive_parity(spark, sf):
    p = S.period_points(spark, sf).withColumnRenamed("period", "artifact")

    def part(key, value, text=None, keep="true"):
        return p.where(keep).select("artifact", F.lit(key).alias("key"), "time", "iy", "ix", value.cast("double").alias("value"), (text if text is not None else F.lit(None).cast("string")).alias("text"))

    dates = part("dates", F.lit(None), F.date_format("time", "yyyy-MM-dd"))
    candidate = part("sim", F.col("raw")).unionByName(part("obs", F.col("obs"))).unionByName(dates)
    archive = part("sim", F.col("bc")).unionByName(part("obs", F.col("obs"), keep="obs > 5 and artifact <> 'test_future'")).unionByName(dates)
    return align.archive_parity(candidate, archive)


@query("left_time:d right_time:d mean_abs_diff:f status:s", "C13", """
    WITH d AS (SELECT DISTINCT time FROM daily_points), pr AS (SELECT time AS left_time, (time + INTERVAL 2 YEAR)::TIMESTAMP AS right_time FROM d WHERE time >= '1997-01-01' AND month(time) IN (1, 7)),
    m AS (SELECT left_time, right_time, avg(abs(l.raw - r.raw)) AS v FROM pr JOIN daily_points l ON l.time = left_time JOIN daily_points r ON r.time = right_time AND r.iy = l.iy AND r.ix = l.ix GROUP BY 1, 2)
    SELECT left_time, right_time, v AS mean_abs_diff, CASE WHEN right_time NOT IN (SELECT time FROM d) THEN 'missing' WHEN v IS NULL THEN 'skipped' WHEN v < 8 THEN 'fail' ELSE 'ok' END AS status FROM pr LEFT JOIN m USING (left_time, right_time)""")
def cross_period_repeat(spark, sf):
    p = S.daily_points(spark, sf).select("time", "iy", "ix", F.col("raw").alias("value"))
    days = timeops.filter_dates(p, "1997-01-01").where(F.month("time").isin(1, 7)).select("time").distinct()
    pairs = days.select(F.col("time").alias("left_time"), (F.col("time") + F.expr("INTERVAL '2' YEAR")).alias("right_time"))
    return align.cross_period_repeat(p, pairs, 8.0)


# --- correction validation -----------------------------------------------------------------------------

_Q = "count(value) AS count, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95"


@query("period:s series:s count:l mean:f std:f q05:f q50:f q95:f mean_bias_vs_obs:f rmse_vs_obs:f std_delta_vs_obs:f q05_bias_vs_obs:f q50_bias_vs_obs:f q95_bias_vs_obs:f", "D29", f"""
    WITH ok AS (SELECT * FROM period_points WHERE obs IS NOT NULL AND period <> 'test_future'), long AS (SELECT period, 'obs' AS series, obs AS value, obs FROM ok UNION ALL SELECT period, 'raw', raw, obs FROM ok UNION ALL SELECT period, 'bc', bc, obs FROM ok),
    s AS (SELECT period, series, {_Q}, avg(value - obs) AS b, sqrt(avg((value - obs) * (value - obs))) AS r FROM long GROUP BY 1, 2)
    SELECT s.period, s.series, s.count, s.mean, s.std, s.q05, s.q50, s.q95, s.b AS mean_bias_vs_obs, s.r AS rmse_vs_obs, s.std - o.std AS std_delta_vs_obs, s.q05 - o.q05 AS q05_bias_vs_obs, s.q50 - o.q50 AS q50_bias_vs_obs, s.q95 - o.q95 AS q95_bias_vs_obs
    FROM s JOIN s o ON o.period = s.period AND o.series = 'obs'""")
def correction_validation_hist(spark, sf):
    return compare.correction_validation_hist(S.period_points(spark, sf).where("period <> 'test_future'"))


@query("period:s series:s count:l mean:f std:f q05:f q50:f q95:f mean_shift_vs_hist_test:f std_shift_vs_hist_test:f q05_shift_vs_hist_test:f q50_shift_vs_hist_test:f q95_shift_vs_hist_test:f", "D30", f"""
    WITH long AS (SELECT period, 'raw' AS series, raw AS value FROM period_points UNION ALL SELECT period, 'bc', bc FROM period_points), s AS (SELECT period, series, {_Q} FROM long GROUP BY 1, 2)
    SELECT f.*, f.mean - h.mean AS mean_shift_vs_hist_test, f.std - h.std AS std_shift_vs_hist_test, f.q05 - h.q05 AS q05_shift_vs_hist_test, f.q50 - h.q50 AS q50_shift_vs_hist_test, f.q95 - h.q95 AS q95_shift_vs_hist_test
    FROM s f JOIN s h ON f.series = h.series WHERE f.period = 'test_future' AND h.period = 'test_hist'""")
def correction_validation_future(spark, sf):
    return compare.correction_validation_future(S.period_points(spark, sf), "test_hist", "test_future")


# --- roll-ups ------------------------------------------------------------------------------------------

# Skill chunks of "models" (return flags) and "windows" (years): raw and ml rows for each, baseline rows with
# a tag (line status) for some of the models only.
_SK = f"count(*) AS n, avg(p - obs) AS bias, sqrt(avg((p - obs) * (p - obs))) AS rmse, {corr_sql('p', 'obs')} AS corr, stddev_pop(p) AS std, stddev_pop(obs) AS truth_std"
_CHUNKS = f"""chunks AS (SELECT l_returnflag AS model, CAST(year(time) AS VARCHAR) AS win, 'ml' AS comparison, NULL AS bc_model, NULL AS bc_tag, 0 AS seen, {_SK.replace('p', 'p')} FROM (SELECT *, ml AS p FROM line_rows WHERE obs IS NOT NULL) GROUP BY 1, 2
    UNION ALL SELECT l_returnflag, CAST(year(time) AS VARCHAR), 'raw', NULL, NULL, 1, {_SK} FROM (SELECT *, raw AS p FROM line_rows WHERE obs IS NOT NULL) GROUP BY 1, 2
    UNION ALL SELECT l_returnflag, CAST(year(time) AS VARCHAR), 'bc', CASE l_linestatus WHEN 'O' THEN 'bc_baseline' ELSE 'bc_baseline_alt' END, CASE l_linestatus WHEN 'O' THEN '' ELSE 'alt tag' END, CASE l_linestatus WHEN 'O' THEN 3 ELSE 2 END, {_SK}
      FROM (SELECT *, bc AS p FROM line_rows WHERE obs IS NOT NULL AND l_returnflag <> 'N') GROUP BY 1, 2, l_linestatus)"""
_ROLL = f"""{_CHUNKS},
    bcr AS (SELECT *, CASE WHEN trim(coalesce(bc_tag, '')) = '' OR bc_model = 'bc_baseline' THEN 0 ELSE 1 END AS pref FROM chunks WHERE comparison = 'bc'),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, win ORDER BY pref, seen) AS k FROM bcr) WHERE k = 1),
    shared AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY pref, seen, model) AS k FROM bcr) WHERE k = 1),
    base AS (SELECT m.model, m.win, m.bias AS ml_bias, m.rmse AS ml_rmse, m.corr AS ml_corr, m.std AS ml_std, r.bias AS raw_bias, r.rmse AS raw_rmse, r.corr AS raw_corr, m.truth_std,
      CASE WHEN o.rmse IS NOT NULL THEN o.bias ELSE s.bias END AS bc_bias, CASE WHEN o.rmse IS NOT NULL THEN o.rmse ELSE s.rmse END AS bc_rmse, CASE WHEN o.rmse IS NOT NULL THEN o.corr ELSE s.corr END AS bc_corr, CASE WHEN o.rmse IS NOT NULL THEN o.std ELSE s.std END AS bc_std
      FROM chunks m JOIN chunks r ON r.model = m.model AND r.win = m.win AND r.comparison = 'raw' LEFT JOIN own o ON o.model = m.model AND o.win = m.win LEFT JOIN shared s ON s.win = m.win WHERE m.comparison = 'ml'),
    lab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win, bc_model ORDER BY seen, model) AS k FROM bcr) WHERE k = 1),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY model) AS k FROM base) WHERE k = 1),
    rolled AS (SELECT model, win, ml_bias, ml_rmse, ml_corr, ml_std, raw_bias, raw_rmse, raw_corr, truth_std, bc_bias, bc_rmse, bc_corr, bc_std FROM base
      UNION ALL SELECT l.bc_model, f.win, l.bias, l.rmse, l.corr, l.std, raw_bias, raw_rmse, raw_corr, f.truth_std, bc_bias, bc_rmse, bc_corr, bc_std FROM firsts f JOIN lab l ON l.win = f.win)"""


def chunk_rows(spark, sf):
    rows = S.line_rows(spark, sf).where("obs is not null")

    def part(comparison, value, seen, label=None, tag=None, keep="true", extra=()):
        none = F.lit(None).cast("string")
        acc = skill.paired_accumulator(rows.where(keep).withColumn("_p", F.col(value)), [F.col("l_returnflag").alias("model"), F.year("time").cast("string").alias("window"), *extra], "_p")
        return acc.select("model", "window", F.lit(comparison).alias("comparison"), (label if label is not None else none).alias("bc_model"), (tag if tag is not None else none).alias("bc_tag"), seen.alias("seen"),
                          F.col("bias_a_minus_truth").alias("bias"), "rmse", "corr", F.col("a_std").alias("std"), "truth_std")

    o = F.col("l_linestatus") == "O"
    # Baseline chunks are numbered by label, then by model, as a listing of chunk files would be.
    order = F.when(o, 3000).otherwise(2000) + F.ascii("model")
    bc = part("bc", "bc", order, F.when(o, "bc_baseline").otherwise("bc_baseline_alt"), F.when(o, "").otherwise("alt tag"), "l_returnflag <> 'N'", ["l_linestatus"])
    return part("ml", "ml", F.lit(0)).unionByName(part("raw", "raw", F.lit(1))).unionByName(bc)


@query("model:s window:s ml_bias:f ml_rmse:f ml_corr:f ml_std:f raw_bias:f raw_rmse:f raw_corr:f truth_std:f bc_bias:f bc_rmse:f bc_corr:f bc_std:f rmse_reduction:f bc_rmse_reduction:f", "D32 C14 G6",
       f'WITH {_ROLL} SELECT *, win AS "window", raw_rmse - ml_rmse AS rmse_reduction, raw_rmse - bc_rmse AS bc_rmse_reduction FROM rolled')
def model_rollup(spark, sf):
    return compare.model_rollup(chunk_rows(spark, sf))


@query("model:s mean_rmse:f max_abs_bias:f", "D33", f"WITH {_ROLL} SELECT model, avg(ml_rmse) AS mean_rmse, max(abs(ml_bias)) AS max_abs_bias FROM rolled GROUP BY 1")
def method_ranking(spark, sf):
    return compare.method_ranking(compare.model_rollup(chunk_rows(spark, sf)))


@query("model:s window:s bc_rmse:f", "C14", f'WITH {_ROLL} SELECT model, win AS "window", bc_rmse FROM base')
def shared_baseline(spark, sf):
    chunks = chunk_rows(spark, sf)
    return compare.with_shared_baseline(chunks.where("comparison = 'ml'").select("model", "window"), chunks.where("comparison = 'bc'"))


@query("month:i mean:f", "D37", "SELECT month(time) AS month, avg(obs) AS mean FROM daily_points GROUP BY 1")
def seasonal_cycle(spark, sf):
    return compare.seasonal_cycle(S.observed(spark, sf))


_YEARS = range(1995, 2002)


@query("month:i " + " ".join(f"y{y}:f" for y in _YEARS), "D37", "SELECT month(time) AS month, " + ", ".join(f"avg(obs) FILTER (year(time) = {y}) AS y{y}" for y in _YEARS) + " FROM daily_points GROUP BY 1")
def month_year_matrix(spark, sf):
    return compare.month_year_matrix(S.observed(spark, sf), _YEARS)


_METRICS = ["rmse_temporal_mean", "bias_spatial_mean", "variability_mean"]


@query("metric:s method:s all:f summer:f winter:f", "D42", f"WITH t AS ({summary_sql('method_points', 'method')}) " + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, method, max({m}) FILTER (season = 'all') AS "all", max({m}) FILTER (season = 'summer') AS summer, max({m}) FILTER (season = 'winter') AS winter FROM t GROUP BY method""" for m in _METRICS))
def metric_matrix(spark, sf):
    return compare.metric_matrix(skill.skill_summary(S.method_pairs(spark, sf), ["method"]), _METRICS, test="method")


@query("method:s low:f q25:f median:f q75:f high:f", "D42", """
    SELECT method, min(x) AS low, quantile_cont(x, 0.25) AS q25, median(x) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS high FROM (SELECT method, time, sqrt(avg((pred - obs) * (pred - obs))) AS x FROM method_points GROUP BY 1, 2) GROUP BY 1""")
def box_statistics(spark, sf):
    detail = skill.skill_by_time(S.method_pairs(spark, sf), ["method"]).withColumnRenamed("rmse", "value")
    return compare.box_statistics(detail, ["method"])


_HISTORY = """SELECT run, epoch, train_loss, CASE WHEN epoch % 2 = 1 THEN v END AS val_loss FROM
    (SELECT l_returnflag AS run, date_diff('month', DATE '1995-01-01', time::DATE) AS epoch, avg(raw) AS train_loss, avg(ml) AS v FROM line_rows GROUP BY 1, 2)"""


def training_history(spark, sf):
    rows = S.line_rows(spark, sf)
    epoch = ((F.year("time") - 1995) * 12 + F.month("time") - 1).alias("epoch")
    table = rows.groupBy(F.col("l_returnflag").alias("run"), epoch).agg(F.avg("raw").alias("train_loss"), F.avg("ml").alias("v"))
    return table.select("run", "epoch", "train_loss", F.when(F.col("epoch") % 2 == 1, F.col("v")).alias("val_loss"))


@query("run:s epoch:i curve:s value:f", "D43", f"SELECT run, epoch, 'train_loss' AS curve, train_loss AS value FROM ({_HISTORY}) UNION ALL SELECT run, epoch, 'val_loss', val_loss FROM ({_HISTORY}) WHERE val_loss IS NOT NULL")
def training_curves(spark, sf):
    return compare.training_curves(training_history(spark, sf))


@query("run:s best_epoch:i best_val_loss:f", "D43", f"SELECT run, arg_min(epoch, val_loss) AS best_epoch, min(val_loss) AS best_val_loss FROM ({_HISTORY}) GROUP BY 1")
def best_epoch(spark, sf):
    return compare.best_epoch(training_history(spark, sf))


@query("run:s epoch:i val_loss:f", "G4", f"SELECT run, epoch, val_loss FROM ({_HISTORY}) ORDER BY val_loss NULLS LAST, run, epoch LIMIT 1")
def best_run(spark, sf):
    return compare.best_run(training_history(spark, sf))


@query("iy:i ix:i value:f", "D44", """
    WITH f AS (SELECT strftime(time, '%Y-%m') AS part, time, iy, ix, raw FROM daily_points), m AS (SELECT part, min(time) AS time FROM f GROUP BY 1) SELECT iy, ix, avg(raw) AS value FROM f JOIN m USING (part, time) GROUP BY 1, 2""")
def reference_mean_field(spark, sf):
    field = S.daily_points(spark, sf).select(F.date_format("time", "yyyy-MM").alias("part"), "time", "iy", "ix", F.col("raw").alias("value"))
    return compare.reference_mean_field(field, "part")


def xy_samples(spark, sf):
    each = F.explode(F.array(
        F.struct(F.lit("x").alias("role"), F.lit("ml input").alias("channel"), F.col("ml").alias("value")),
        F.struct(F.lit("x").alias("role"), F.lit("raw input").alias("channel"), F.col("raw").alias("value")),
        F.struct(F.lit("y").alias("role"), F.lit("target").alias("channel"), F.col("obs").alias("value")))).alias("c")
    return S.daily_points(spark, sf).select("time", "iy", "ix", each).select("time", "iy", "ix", "c.*")


@query("iy:i ix:i bias:f n:l", "D46", "SELECT iy, ix, avg(pred - obs) AS bias, count(obs) AS n FROM (SELECT iy, ix, obs, raw AS pred FROM daily_points) GROUP BY 1, 2")
def direct_predictions(spark, sf):
    pairs = compare.direct_predictions(xy_samples(spark, sf), ["ml input", "raw input"])
    return pairs.groupBy("iy", "ix").agg(F.avg(F.col("pred") - F.col("obs")).alias("bias"), F.count("obs").alias("n"))


@query("name:s direct:i", "D46", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand || '_raw' ELSE 'unet_' || p_brand END AS name, CAST(p_size % 2 = 0 AS INTEGER) AS direct FROM part")
def direct_test_names(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("_raw"))).otherwise(F.concat(F.lit("unet_"), "p_brand"))
    return S.table(spark, sf, "part").select(name.alias("name")).distinct().withColumn("direct", compare.uses_direct_predictions("name").cast("int"))


_SUM_COLS = [c.split(":")[0] for c in SUMMARY.split()[1:]]
_VAL_COLS = "bias std_ratio q5_bias q50_bias q95_bias wasserstein distribution_sample_size matched_days autocorr_obs_mean autocorr_pred_mean autocorr_bias_mean spatial_corr spatial_rmse".split()


def _block(rel: str, block: str, cols, season: str) -> str:
    return " UNION ALL ".join(f"SELECT method, '{block}' AS block, {season} AS season, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {rel}" for c in cols)


@query("method:s block:s season:s metric:s value:f", "D47", f"""WITH method_months AS (SELECT method, date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(obs) AS obs, avg(pred) AS pred FROM method_points GROUP BY ALL),
    d AS ({summary_sql('method_points', 'method')}), m AS ({summary_sql('method_months', 'method')}), v AS ({value_sql('method_points', 'method')})
    {_block('d', 'daily', _SUM_COLS, 'season')} UNION ALL {_block('m', 'monthly', _SUM_COLS, 'season')} UNION ALL {_block('v', 'value', _VAL_COLS, "'all'")}
    UNION ALL SELECT method, 'density', series, 'bin_' || bin, coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY method, series) * 1.5) FROM (SELECT * FROM (SELECT DISTINCT method FROM method_points), (VALUES ('obs'), ('pred')) s(series), range(40) r(bin))
    LEFT JOIN (SELECT method, series, least(floor(v * 40 / 60)::INT, 39) AS bin, count(*) AS n FROM (SELECT method, 'obs' AS series, obs AS v FROM method_points UNION ALL SELECT method, 'pred', pred FROM method_points) WHERE v BETWEEN 0 AND 60 GROUP BY ALL) USING (method, series, bin)""")
def comparison_suite(spark, sf):
    return compare.comparison_suite(S.method_pairs(spark, sf, ordered=True), density_range=(0.0, 60.0), bins=40)


# --- ordered operators ---------------------------------------------------------------------------------

@query("time:d position:l split:s", "E4", """
    WITH o AS (SELECT time, row_number() OVER (ORDER BY time) AS position FROM (SELECT DISTINCT time FROM lineitem_days)), b AS (SELECT min(position) FILTER (time >= '1999-01-01') AS v, min(position) FILTER (time >= '2000-07-01') AS t, min(position) FILTER (time >= '1995-02-01') AS a FROM o)
    SELECT time, position, CASE WHEN position >= a AND position < v - 1 THEN 'train' WHEN position >= v AND position < t - 1 THEN 'val' WHEN position >= t THEN 'test' END AS split FROM o, b""".replace("lineitem_days", "(SELECT l_shipdate AS time FROM lineitem)"))
def sample_split(spark, sf):
    return timeops.split_samples(S.line_rows(spark, sf).select("time"), "1999-01-01", "2000-07-01", "1995-02-01")


@query("time:d source:s group_id:l", "E5", """
    WITH d AS (SELECT time, CASE WHEN time < '1996-05-10' THEN 'a' WHEN time < '1999-02-03' THEN 'b' ELSE 'c' END AS source FROM (SELECT DISTINCT l_shipdate AS time FROM lineitem)),
    f AS (SELECT *, CASE WHEN lag(time) OVER w IS NULL OR source <> lag(source) OVER w OR year(time) <> year(lag(time) OVER w) THEN 1 ELSE 0 END AS c FROM d WINDOW w AS (ORDER BY time)) SELECT time, source, sum(c) OVER (ORDER BY time) AS group_id FROM f""")
def consecutive_groups(spark, sf):
    days = S.line_rows(spark, sf).select("time").distinct()
    source = F.when(F.col("time") < "1996-05-10", "a").when(F.col("time") < "1999-02-03", "b").otherwise("c")
    return timeops.consecutive_groups(days.withColumn("source", source), "source")


@query("model:s year:i label:s unit:s", "E7", """
    WITH t AS (SELECT l_returnflag AS model, year(time) AS year, CASE WHEN year(time) % 3 = 0 THEN l_returnflag || CAST(year(time) AS VARCHAR) END AS label, CASE WHEN year(time) = 1998 AND l_returnflag <> 'N' THEN 'K' END AS unit FROM line_rows GROUP BY ALL)
    SELECT model, year, coalesce(last_value(label IGNORE NULLS) OVER a, first_value(label IGNORE NULLS) OVER b, '') AS label, coalesce(last_value(unit IGNORE NULLS) OVER a, first_value(unit IGNORE NULLS) OVER b, '') AS unit FROM t
    WINDOW a AS (PARTITION BY model ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY model ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def metadata_fill(spark, sf):
    t = S.line_rows(spark, sf).select(F.col("l_returnflag").alias("model"), F.year("time").alias("year")).distinct()
    label = F.when(F.col("year") % 3 == 0, F.concat("model", F.col("year").cast("string"))).otherwise("")
    unit = F.when((F.col("year") == 1998) & (F.col("model") != "N"), "K")
    return compare.fill_metadata(t.withColumns({"label": label, "unit": unit}), ["label", "unit"], "year", ["model"])


@query("time:d position:l batch:l", "E8", "SELECT time, position, (position - 1) // 32 AS batch FROM (SELECT time, row_number() OVER (ORDER BY time) AS position FROM (SELECT DISTINCT l_shipdate AS time FROM lineitem))")
def date_batches(spark, sf):
    return timeops.batches(S.line_rows(spark, sf).select("time"), 32)


# --- sorts and sets ------------------------------------------------------------------------------------

@query("time:d", "G2", "SELECT min(l_shipdate) AS time FROM lineitem")
def earliest_sample(spark, sf):
    from gridloom.sources.catalog import first_sample
    return first_sample(S.line_rows(spark, sf))


@query("time:d iy:i ix:i value:f", "G1", "SELECT time, iy, ix, raw AS value FROM daily_points")
def sorted_by_time(spark, sf):
    return S.daily_points(spark, sf).select("time", "iy", "ix", F.col("raw").alias("value")).orderBy("time")


@query("model:s order_rank:i first_seen:l", "G5 G9", """
    SELECT p_brand AS model, CASE p_brand WHEN 'Brand#5' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 1000000 END AS order_rank, min(p_partkey) AS first_seen FROM part GROUP BY 1, 2""")
def preferred_model_order(spark, sf):
    models = compare.first_seen(S.table(spark, sf, "part").withColumnRenamed("p_brand", "model"), "model", "p_partkey")
    listed = {"Brand#5": 1, "Brand#2": 2}
    ranks = models.select("model", F.try_element_at(F.create_map(*[F.lit(x) for kv in listed.items() for x in kv]), F.col("model")).alias("rank")).where("rank is not null")
    return compare.preferred_order(models, ranks)


@query("model:s kind:s bc_tag:s first_seen:l", "G10", """
    SELECT CASE WHEN p_size < 10 THEN 'bc_baseline_' || p_type ELSE p_type END AS model, CASE WHEN p_size < 10 THEN 'baseline' ELSE 'model' END AS kind,
    coalesce(replace(trim(arg_min(p_name, p_partkey) FILTER (p_size % 2 = 0)), ' ', '_'), '') AS bc_tag, min(p_partkey) AS first_seen FROM part GROUP BY 1, 2""")
def split_methods(spark, sf):
    part = S.table(spark, sf, "part")
    model = F.when(F.col("p_size") < 10, F.concat(F.lit("bc_baseline_"), "p_type")).otherwise(F.col("p_type"))
    return compare.split_methods(part.select(model.alias("model"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("bc_tag"), F.col("p_partkey").alias("seen")))


@query("day:d", "G7", "SELECT o_orderdate AS day FROM orders INTERSECT SELECT l_shipdate FROM lineitem")
def common_dates(spark, sf):
    return S.table(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).intersect(S.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("day")))


@query("day:d side:s", "G8", """
    SELECT day, 'missing' AS side FROM (SELECT o_orderdate AS day FROM orders EXCEPT SELECT l_shipdate FROM lineitem) UNION ALL SELECT day, 'extra' FROM (SELECT l_shipdate AS day FROM lineitem EXCEPT SELECT o_orderdate FROM orders)
    UNION ALL SELECT day, 'any' FROM (SELECT o_orderdate AS day FROM orders UNION SELECT l_shipdate FROM lineitem)""")
def date_differences(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    s = S.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("day")).distinct()
    tag = lambda df, name: df.withColumn("side", F.lit(name))
    return tag(o.exceptAll(s), "missing").unionByName(tag(s.exceptAll(o), "extra")).unionByName(tag(o.union(s).distinct(), "any"))


@query("model:s n:l", "G6", "SELECT l_returnflag AS model, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def stacked_counts(spark, sf):
    count = lambda t, c: S.table(spark, sf, t).groupBy(F.col(c).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return count("lineitem", "l_returnflag").unionByName(count("orders", "o_orderstatus"))


# --- data quality --------------------------------------------------------------------------------------

@query("source:s variable:s n_times:l expected:l status:s", "K1", """
    SELECT l_returnflag AS source, l_linestatus AS variable, count(DISTINCT time) AS n_times, 2499 AS expected, CASE WHEN count(DISTINCT time) = 2499 THEN 'ok' ELSE 'fail' END AS status FROM line_rows GROUP BY 1, 2""")
def time_lengths(spark, sf):
    rows = S.line_rows(spark, sf).withColumnsRenamed({"l_returnflag": "source", "l_linestatus": "variable"})
    return quality.time_lengths(rows, 2499)


@query("date:s roles:s channels:l ny:l nx:l x_finite:f y_finite:f expected:s status:s", "K2", """
    SELECT strftime(time, '%Y-%m-%d') AS date, CASE WHEN time < '2001-06-01' THEN 'x,y' ELSE 'x' END AS roles, 2 AS channels, count(DISTINCT iy) AS ny, count(DISTINCT ix) AS nx, 1.0 AS x_finite, CASE WHEN time < '2001-06-01' THEN avg((obs IS NOT NULL)::INT) END AS y_finite,
    CASE WHEN time < '2001-01-01' THEN 'x,y' ELSE 'x' END AS expected, CASE WHEN time >= '2001-01-01' AND time < '2001-06-01' THEN 'fail' ELSE 'ok' END AS status FROM daily_points GROUP BY time""")
def sample_structure(spark, sf):
    samples = xy_samples(spark, sf).where((F.col("role") == "x") | (F.col("time") < "2001-06-01"))
    return quality.structure(samples, "2000-12-31").withColumn("date", F.col("date").cast("string"))


@query("variable:s min:f max:f mean:f status:s", "K3", """
    WITH f AS (SELECT 'tas' AS variable, obs + 250 AS value FROM daily_points UNION ALL SELECT 'cold', obs FROM daily_points) SELECT variable, min(value) AS min, max(value) AS max, avg(value) AS mean, CASE WHEN avg(value) > 200 AND avg(value) < 320 THEN 'PASS' ELSE 'FAIL' END AS status FROM f GROUP BY 1""")
def physical_range(spark, sf):
    o = S.observed(spark, sf)
    field = o.select(F.lit("tas").alias("variable"), (F.col("value") + 250).alias("value")).unionByName(o.select(F.lit("cold").alias("variable"), "value"))
    return quality.physical_range(field, keys=["variable"])


@query("status:s", "K4 K1", "SELECT CASE WHEN bool_and(n = 2499) THEN 'ok' ELSE 'fail' END AS status FROM (SELECT count(DISTINCT time) AS n FROM line_rows GROUP BY l_returnflag)")
def overall_status(spark, sf):
    rows = S.line_rows(spark, sf)
    return quality.overall_status(quality.time_lengths(rows, 2499, ["l_returnflag"]))


@query("time:d", "K6", "SELECT time FROM (SELECT o_orderdate AS time FROM orders EXCEPT SELECT l_shipdate FROM lineitem WHERE l_returnflag = 'A')")
def missing_outputs(spark, sf):
    expected = S.table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"))
    return quality.missing_outputs(expected, S.line_rows(spark, sf).where("l_returnflag = 'A'"))


@query("n_values:l n_dates:l unmatched:l status:s", "K7", """
    WITH a AS (SELECT count(DISTINCT l_shipdate) AS a FROM lineitem), b AS (SELECT count(DISTINCT o_orderdate) AS b FROM orders) SELECT a AS n_values, b AS n_dates, abs(a - b) AS unmatched, CASE WHEN a = b THEN 'ok' ELSE 'fail' END AS status FROM a, b""")
def series_length_match(spark, sf):
    number = lambda t, c: positions(S.table(spark, sf, t).select(F.col(c).alias("time")).distinct(), [], "time", calendar_bucket("time"))
    return quality.length_match(number("lineitem", "l_shipdate"), number("orders", "o_orderdate"))
