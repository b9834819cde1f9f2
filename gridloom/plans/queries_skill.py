"""Skill, diagnostics, signals and distributions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import align, distrib, ecdf, signal, skill, timeops, value
from gridloom.plans import standins as S
from gridloom.plans.registry import query


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN var_pop({a}) = 0 OR var_pop({b}) = 0 THEN NULL ELSE covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) END"


def seasons_sql(rel: str) -> str:
    return (f"SELECT *, 'all' AS season FROM {rel} UNION ALL SELECT *, CASE WHEN month(time) IN (6, 7, 8) THEN 'summer' ELSE 'winter' END FROM {rel} "
            "WHERE month(time) IN (6, 7, 8, 12, 1, 2)")


def summary_sql(rel: str, keys: str = "") -> str:
    """The seven-metric summary of a relation (keys, time, iy, ix, obs, pred)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {k}iy, ix ORDER BY time"
    using = f"({k}season)"
    return f"""WITH pt AS (SELECT {k}time, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, {corr_sql('pred', 'obs')} AS corr FROM {rel} GROUP BY ALL),
    t AS (SELECT {k}season, avg(rmse) AS rmse_temporal_mean, avg(corr) AS corr_spatial_mean FROM ({seasons_sql('pt')}) GROUP BY ALL),
    pc AS (SELECT {k}season, iy, ix, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, avg(pred - obs) AS bias, {corr_sql('pred', 'obs')} AS corr FROM ({seasons_sql(rel)}) GROUP BY ALL),
    c AS (SELECT {k}season, avg(rmse) AS rmse_spatial_mean, avg(bias) AS bias_spatial_mean, stddev_pop(bias) AS bias_spatial_std, avg(corr) FILTER (season = 'all') AS corr_temporal_mean FROM pc GROUP BY ALL),
    st AS (SELECT {k}time, iy, ix, abs(pred - lag(pred) OVER ({part})) AS dp, abs(obs - lag(obs) OVER ({part})) AS d_o FROM {rel}),
    v AS (SELECT {k}season, avg(x) AS variability_mean FROM (SELECT {k}season, iy, ix, avg(dp) - avg(d_o) AS x FROM ({seasons_sql('st')}) GROUP BY ALL) GROUP BY ALL)
    SELECT * FROM t LEFT JOIN c USING {using} LEFT JOIN v USING {using}"""


SUMMARY = "season:s rmse_temporal_mean:f rmse_spatial_mean:f bias_spatial_mean:f bias_spatial_std:f corr_spatial_mean:f corr_temporal_mean:f variability_mean:f"


@query(SUMMARY, "D12 D13 D14 D15 E2", summary_sql("valid_points"))
def skill_summary(spark, sf):
    return skill.skill_summary(S.pairs(spark, sf))


@query("method:s " + SUMMARY, "D17 D15", summary_sql("method_points", "method"))
def skill_summary_by_method(spark, sf):
    return skill.skill_summary(S.method_pairs(spark, sf), ["method"])


@query(SUMMARY, "D16 D4", summary_sql("valid_month_means").replace("WITH pt", "WITH valid_month_means AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, iy, ix, avg(obs) AS obs, avg(pred) AS pred FROM valid_points GROUP BY 1, 2, 3), pt", 1))
def monthly_skill_summary(spark, sf):
    return skill.monthly_skill_summary(S.pairs(spark, sf))


@query(SUMMARY, "D17", summary_sql("truth_points").replace("WITH pt", "WITH truth_points AS (SELECT time, iy, ix, ml AS obs, raw AS pred FROM daily_points), pt", 1))
def skill_against_model_truth(spark, sf):
    return skill.skill_summary(S.daily_points(spark, sf).select("time", "iy", "ix", F.col("ml").alias("obs"), F.col("raw").alias("pred")))


@query("time:d iy:i ix:i obs:f pred:f", "C1 K5", "SELECT time, iy, ix, obs, pred FROM valid_points JOIN (SELECT time, iy, ix FROM daily_points WHERE time >= '1996-06-01') USING (time, iy, ix)")
def aligned_pairs(spark, sf):
    p = S.daily_points(spark, sf)
    obs = p.where("obs is not null").select("time", "iy", "ix", "obs")
    pred = timeops.filter_dates(p.select("time", "iy", "ix", F.col("raw").alias("pred")), "1996-06-01")
    return align.require_rows(align.align(obs, pred), "no common time and cell")


@query("time:d rmse:f corr:f", "D12", f"SELECT time, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, {corr_sql('pred', 'obs')} AS corr FROM valid_points GROUP BY 1")
def skill_by_time(spark, sf):
    return skill.skill_by_time(S.pairs(spark, sf))


@query("iy:i ix:i rmse:f bias:f corr:f", "D13", f"SELECT iy, ix, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, avg(pred - obs) AS bias, {corr_sql('pred', 'obs')} AS corr FROM valid_points GROUP BY 1, 2")
def skill_by_cell(spark, sf):
    return skill.skill_by_cell(S.pairs(spark, sf))


@query("window:s method:s count:l a_mean:f truth_mean:f bias_a_minus_truth:f mae:f rmse:f a_std:f truth_std:f corr:f", "D11 B17", " UNION ALL ".join(
    f"""SELECT '{w}' AS "window", method, count(*) AS count, avg(pred) AS a_mean, avg(obs) AS truth_mean, avg(pred - obs) AS bias_a_minus_truth, avg(abs(pred - obs)) AS mae,
    sqrt(avg((pred - obs) * (pred - obs))) AS rmse, stddev_pop(pred) AS a_std, stddev_pop(obs) AS truth_std, {corr_sql('pred', 'obs')} AS corr
    FROM method_points WHERE time::DATE BETWEEN '{a}' AND '{b}' GROUP BY method""" for w, a, b in S.WINDOWS))
def paired_accumulator(spark, sf):
    return skill.paired_accumulator(timeops.tag_windows(S.method_pairs(spark, sf), S.WINDOWS), ["window", "method"])


@query("time:d iy:i ix:i d_value:f", "E1", "SELECT time, iy, ix, obs - lag(obs) OVER (PARTITION BY iy, ix ORDER BY time) AS d_value FROM valid_points")
def daily_increments(spark, sf):
    return skill.increments(S.observed(spark, sf).where("value is not null"))


@query("iy:i ix:i variability:f", "E1", """SELECT iy, ix, avg(abs(d)) AS variability FROM (SELECT iy, ix, CASE WHEN date_diff('day', lag(time) OVER w, time) <= 3 THEN obs - lag(obs) OVER w END AS d
    FROM valid_points WINDOW w AS (PARTITION BY iy, ix ORDER BY time)) GROUP BY 1, 2""")
def mean_absolute_increment(spark, sf):
    steps = skill.increments(S.observed(spark, sf).where("value is not null"), max_gap_days=3)
    return steps.groupBy("iy", "ix").agg(F.avg(F.abs("d_value")).alias("variability"))


@query("season:s iy:i ix:i variability:f", "E2", f"""WITH st AS (SELECT time, iy, ix, abs(pred - lag(pred) OVER w) AS dp, abs(obs - lag(obs) OVER w) AS d_o FROM valid_points WINDOW w AS (PARTITION BY iy, ix ORDER BY time))
    SELECT season, iy, ix, avg(dp) - avg(d_o) AS variability FROM ({seasons_sql('st')}) GROUP BY 1, 2, 3""")
def variability_bias(spark, sf):
    return skill.variability_bias(S.pairs(spark, sf))


_WINDOWED = " UNION ALL ".join(f"SELECT '{w}' AS wname, * FROM method_points WHERE time::DATE BETWEEN '{a}' AND '{b}'" for w, a, b in S.WINDOWS)


@query("window:s method:s days:l mean_bias:f rmse:f mean_value:f truth_mean:f mean_abs_error:f day_to_day_variability_bias:f spatial_variability_bias:f annual_variability_bias:f", "D31", f"""
    WITH w AS ({_WINDOWED}),
    base AS (SELECT wname, method, count(DISTINCT time) AS days, avg(pred - obs) AS mean_bias, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, avg(pred) AS mean_value, avg(obs) AS truth_mean, avg(abs(pred - obs)) AS mean_abs_error FROM w GROUP BY 1, 2),
    st AS (SELECT wname, method, avg(abs(dp)) - avg(abs(d_o)) AS day_to_day_variability_bias FROM (SELECT wname, method, pred - lag(pred) OVER p AS dp, obs - lag(obs) OVER p AS d_o FROM w WINDOW p AS (PARTITION BY wname, method, iy, ix ORDER BY time)) GROUP BY 1, 2),
    bt AS (SELECT wname, method, time, stddev_pop(pred) - stddev_pop(obs) AS spread, avg(pred) AS p, avg(obs) AS o FROM w GROUP BY 1, 2, 3),
    sp AS (SELECT wname, method, avg(spread) AS spatial_variability_bias FROM bt GROUP BY 1, 2),
    an AS (SELECT wname, method, stddev_pop(p) - stddev_pop(o) AS annual_variability_bias FROM (SELECT wname, method, year(time), avg(p) AS p, avg(o) AS o FROM bt GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT wname AS "window", * FROM base JOIN st USING (wname, method) JOIN sp USING (wname, method) JOIN an USING (wname, method)""")
def window_statistics(spark, sf):
    return skill.window_statistics(S.method_pairs(spark, sf), S.WINDOWS)


@query("method:s rmse:f mae:f loss:f", "D34", """
    SELECT method, sqrt(sum(w * e * e) / (sum(w) + 1e-8)) AS rmse, sum(w * abs(e)) / (sum(w) + 1e-8) AS mae, sqrt(sum(w * e * e) / sum(w)) AS loss
    FROM (SELECT method, pred - obs AS e, 1 + iy % 3 AS w FROM method_points WHERE obs <> 25) GROUP BY 1""")
def masked_errors(spark, sf):
    df = S.method_pairs(spark, sf).withColumn("weight", 1.0 + F.col("iy") % 3)
    return skill.masked_errors(df, ["method"], truth="obs", ignore=25.0, weight="weight")


@query("metric:s mean:f min:f max:f n:l", "D36", """
    WITH s AS (SELECT time, sqrt(sum(e * e) / count(*)) AS loss, sqrt(sum(e * e) / (count(*) + 1e-8)) AS rmse, sum(abs(e)) / (count(*) + 1e-8) AS mae FROM (SELECT time, pred - obs AS e FROM valid_points) GROUP BY 1)
    SELECT metric, avg(x) AS mean, min(x) AS min, max(x) AS max, count(x) AS n FROM (SELECT 'loss' AS metric, loss AS x FROM s UNION ALL SELECT 'rmse', rmse FROM s UNION ALL SELECT 'mae', mae FROM s) GROUP BY 1""")
def sample_metric_summary(spark, sf):
    per_sample = skill.masked_errors(S.pairs(spark, sf), ["time"], truth="obs").where("loss is not null")
    return skill.summarise_metrics(per_sample)


# --- marginal, temporal, spatial diagnostics -----------------------------------------------------------

def _w1(rel: str, keys: str = "") -> str:
    k, p = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    return f"""(WITH u AS (SELECT {k}obs AS v, 1 AS a, 0 AS b FROM {rel} UNION ALL SELECT {k}pred, 0, 1 FROM {rel}),
      g AS (SELECT {k}v, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL),
      r AS (SELECT {k}v, lead(v) OVER ({p}ORDER BY v) - v AS step, sum(a) OVER ({p}ORDER BY v) / sum(a) OVER ({p}) AS fa, sum(b) OVER ({p}ORDER BY v) / sum(b) OVER ({p}) AS fb FROM g)
      SELECT {k}sum(abs(fa - fb) * step) AS wasserstein FROM r GROUP BY ALL)"""


def marginal_sql(rel: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    q = ", ".join(f"quantile_cont(pred, {p}) - quantile_cont(obs, {p}) AS {n}_bias" for n, p in (("q5", 0.05), ("q50", 0.5), ("q95", 0.95)))
    join = f"JOIN w USING ({keys})" if keys else ", w"
    return f"""WITH m AS (SELECT {k}avg(pred) - avg(obs) AS bias, stddev_pop(pred) / stddev_pop(obs) AS std_ratio, {q}, count(*) AS distribution_sample_size, count(DISTINCT time::DATE) AS matched_days FROM {rel} GROUP BY ALL),
    w AS {_w1(rel, keys)} SELECT * FROM m {join}"""


def lag_sql(rel: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}avg(o) AS autocorr_obs_mean, avg(p) AS autocorr_pred_mean, avg(p) - avg(o) AS autocorr_bias_mean FROM (SELECT {k}iy, ix, {corr_sql('obs', 'lo')} AS o, {corr_sql('pred', 'lp')} AS p
    FROM (SELECT {k}iy, ix, obs, pred, lag(obs) OVER w AS lo, lag(pred) OVER w AS lp FROM {rel} WINDOW w AS (PARTITION BY {k}iy, ix ORDER BY time)) WHERE lo IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


def map_sql(rel: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}{corr_sql('o', 'p')} AS spatial_corr, sqrt(avg((p - o) * (p - o))) AS spatial_rmse FROM (SELECT {k}iy, ix, avg(obs) AS o, avg(pred) AS p FROM {rel} GROUP BY ALL) GROUP BY ALL"


def value_sql(rel: str, keys: str = "") -> str:
    join = f"JOIN t USING ({keys}) JOIN s USING ({keys})" if keys else ", t, s"
    return f"WITH d AS ({marginal_sql(rel, keys)}), t AS ({lag_sql(rel, keys)}), s AS ({map_sql(rel, keys)}) SELECT * FROM d {join}"


MARGINAL = "bias:f std_ratio:f q5_bias:f q50_bias:f q95_bias:f wasserstein:f"
LAG = "autocorr_obs_mean:f autocorr_pred_mean:f autocorr_bias_mean:f"
MAP = "spatial_corr:f spatial_rmse:f"


@query(MARGINAL, "D18", marginal_sql("valid_points"))
def marginal_metrics(spark, sf):
    return value.marginal_metrics(S.pairs(spark, sf))


@query("method:s wasserstein:f", "D19", f"SELECT * FROM {_w1('method_points', 'method')}")
def wasserstein_distance(spark, sf):
    long = value.long_series(S.method_pairs(spark, sf), ["method"])
    return ecdf.wasserstein(long, ["method"], "value", F.col("series") == "obs")


@query(LAG, "D20", lag_sql("valid_months"))
def lag1_autocorrelation(spark, sf):
    return value.lag1_autocorrelation(S.monthly(spark, sf))


@query(MAP, "D21", map_sql("valid_points"))
def mean_map_skill(spark, sf):
    return value.mean_map_skill(S.pairs(spark, sf))


@query(f"{MARGINAL} distribution_sample_size:l matched_days:l {LAG} {MAP}", "D22", value_sql("valid_points"))
def value_summary(spark, sf):
    return value.value_summary(S.pairs(spark, sf))


@query("iy:i ix:i mean_spell:f", "E3", """
    WITH a AS (SELECT iy, ix, time, coalesce(obs > 25, false) AS on_, row_number() OVER w AS r FROM daily_points WINDOW w AS (PARTITION BY iy, ix ORDER BY time)),
    g AS (SELECT iy, ix, r - row_number() OVER (PARTITION BY iy, ix ORDER BY time) AS island FROM a WHERE on_), n AS (SELECT iy, ix, island, count(*) AS n FROM g GROUP BY 1, 2, 3)
    SELECT c.iy, c.ix, coalesce(avg(n), 0.0) AS mean_spell FROM (SELECT DISTINCT iy, ix FROM daily_points) c LEFT JOIN n USING (iy, ix) GROUP BY 1, 2""")
def mean_spell_length(spark, sf):
    return value.mean_spell_length(S.observed(spark, sf), 25.0)


# Of the query: cells a day, all cells together, and the factors of the arithmetic hash that orders the cells of a day.
SAMPLE_PER_DAY, SAMPLE_TOTAL = 12, 20_000
_SAMPLE_HASH = "(datediff('day', DATE '1970-01-01', time::DATE) * 7919 + iy * 104729 + ix * 1299709 + 7 * 15485863) % 1000003"


@query("time:d iy:i ix:i obs:f pred:f", "E9", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY {_SAMPLE_HASH}, iy, ix) AS r FROM valid_points), n AS (SELECT time, least(count(*), {SAMPLE_PER_DAY}) AS n FROM valid_points GROUP BY 1),
    levels AS (SELECT l, (SELECT sum(least(n, l)) FROM n) AS filled FROM range(0, {SAMPLE_PER_DAY + 1}) t(l)), level AS (SELECT max(l) AS l, max(filled) AS filled FROM levels WHERE filled <= {SAMPLE_TOTAL}),
    quota AS (SELECT time, least(n, l) + (n > l AND row_number() OVER (PARTITION BY n > l ORDER BY time) <= {SAMPLE_TOTAL} - filled)::INT AS quota FROM n, level)
    SELECT time, iy, ix, obs, pred FROM r JOIN quota USING (time) WHERE r <= quota""")
def seeded_daily_sample(spark, sf):
    key = (F.unix_date(F.to_date("time")) * F.lit(7919).cast("long") + F.col("iy") * 104729 + F.col("ix") * 1299709 + 7 * 15485863) % 1000003
    return value.seeded_sample(S.pairs(spark, sf).where("obs is not null"), SAMPLE_PER_DAY, total=SAMPLE_TOTAL, key=key)


# --- area means and signals ----------------------------------------------------------------------------

@query("time:d obs:f raw:f", "D5", "SELECT time, avg(obs) AS obs, avg(raw) AS raw FROM daily_points GROUP BY 1")
def area_mean(spark, sf):
    return signal.area_mean(S.daily_points(spark, sf), values=("obs", "raw"))


@query("method:s year:i value:f", "D6", "SELECT method, year(time) AS year, avg(v) AS value FROM (SELECT method, time, avg(pred) AS v FROM method_points GROUP BY 1, 2) GROUP BY 1, 2")
def annual_mean(spark, sf):
    return signal.annual_mean(S.method_pairs(spark, sf).withColumn("value", F.col("pred")), ["method"])


@query("method:s annual_std:f", "D7", "SELECT method, stddev_pop(y) AS annual_std FROM (SELECT method, year(time), avg(v) AS y FROM (SELECT method, time, avg(pred) AS v FROM method_points GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1")
def annual_variability(spark, sf):
    return signal.annual_variability(S.method_pairs(spark, sf).withColumn("value", F.col("pred")), ["method"])


@query("iy:i ix:i obs:f raw:f", "D8", "SELECT iy, ix, avg(obs) AS obs, avg(raw) AS raw FROM daily_points WHERE time::DATE BETWEEN '1996-01-01' AND '1998-12-31' GROUP BY 1, 2")
def time_mean_map(spark, sf):
    return signal.time_mean_map(timeops.filter_dates(S.daily_points(spark, sf), "1996-01-01", "1998-12-31"), values=("obs", "raw"))


_REF, _FUT = ("1995-01-01", "1997-12-31"), ("2000-01-01", "2001-12-31")


def _change(v: str) -> str:
    return f"avg({v}) FILTER (time::DATE BETWEEN '{_FUT[0]}' AND '{_FUT[1]}') - avg({v}) FILTER (time::DATE BETWEEN '{_REF[0]}' AND '{_REF[1]}')"


@query("iy:i ix:i change:f", "D9", f"SELECT iy, ix, {_change('obs')} AS change FROM daily_points GROUP BY 1, 2")
def climate_change_map(spark, sf):
    return signal.change_map(S.observed(spark, sf), _REF, _FUT)


@query("method:s mean_change:f truth_mean_change:f bias:f rmse:f corr:f std:f truth_std:f", "D10", f"""
    WITH c AS (SELECT method, iy, ix, {_change('pred')} AS c, {_change('obs')} AS t FROM method_points GROUP BY 1, 2, 3)
    SELECT method, avg(c) AS mean_change, avg(t) AS truth_mean_change, avg(c - t) AS bias, sqrt(avg((c - t) * (c - t))) AS rmse, {corr_sql('c', 't')} AS corr, stddev_pop(c) AS std, stddev_pop(t) AS truth_std FROM c WHERE c IS NOT NULL AND t IS NOT NULL GROUP BY 1""")
def signal_summary(spark, sf):
    m = S.method_pairs(spark, sf)
    change = signal.change_map(m, _REF, _FUT, ["method"], "pred")
    truth = signal.change_map(m, _REF, _FUT, ["method"], "obs").withColumnRenamed("change", "truth_change")
    return signal.signal_summary(change.join(truth, ["method", "iy", "ix"]))


@query("year:i ml:f raw:f", "D45", """
    WITH d AS (SELECT label, time, avg(abs(d)) AS v FROM (SELECT label, time, value - lag(value) OVER (PARTITION BY label, iy, ix ORDER BY time) AS d FROM
      (SELECT 'raw' AS label, time, iy, ix, raw AS value FROM daily_points UNION ALL SELECT 'ml', time, iy, ix, ml FROM daily_points)) GROUP BY 1, 2)
    SELECT year(time) AS year, avg(v) FILTER (label = 'ml') AS ml, avg(v) FILTER (label = 'raw') AS raw FROM d GROUP BY 1""")
def annual_variability_by_label(spark, sf):
    p = S.daily_points(spark, sf)
    long = p.select("time", "iy", "ix", F.explode(F.create_map(F.lit("raw"), "raw", F.lit("ml"), "ml")).alias("label", "value"))
    days = p.select("time").distinct().count()
    return signal.annual_variability_by_label(long, {"raw": days, "ml": days})


@query("time:d position:l obs:f raw:f corrected:f", "D49", """
    SELECT * FROM (SELECT time, row_number() OVER (ORDER BY time) AS position, avg(obs) AS obs, avg(raw) AS raw, avg(bc) AS corrected FROM daily_points GROUP BY time) WHERE position BETWEEN 1001 AND 2000""")
def profile_slice(spark, sf):
    return signal.profile_slice(S.daily_points(spark, sf).withColumnRenamed("bc", "corrected"))


@query("period:s time:d raw:f corrected:f", "D50", "SELECT period, time, avg(raw) AS raw, avg(bc) AS corrected FROM period_points GROUP BY 1, 2")
def daily_scatter_input(spark, sf):
    p = S.period_points(spark, sf)
    raw = signal.area_mean(p, ["period"], ["raw"])
    corrected = signal.area_mean(p.withColumnRenamed("bc", "corrected"), ["period"], ["corrected"])
    return raw.join(corrected, ["period", "time"])


# --- distributions -------------------------------------------------------------------------------------

_PROBS = [("p00", 0.0), ("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p100", 1.0)]
_STATS = "count(value) AS count, avg(value) AS mean, stddev_pop(value) AS std, " + ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in _PROBS)
STATS = "count:l mean:f std:f " + " ".join(f"{n}:f" for n, _ in _PROBS)
_LONG = "SELECT period, time, 'obs' AS series, obs AS value FROM period_points UNION ALL SELECT period, time, 'raw', raw FROM period_points UNION ALL SELECT period, time, 'bc', bc FROM period_points"


def long_periods(spark, sf):
    return S.period_points(spark, sf).unpivot(["period", "time", "iy", "ix"], ["obs", "raw", "bc"], "series", "value")


@query("period:s series:s " + STATS, "D23", f"SELECT period, series, {_STATS} FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2")
def distribution_stats(spark, sf):
    return distrib.distribution_stats(long_periods(spark, sf), ["period", "series"])


@query("time:d series:s " + STATS, "D24", f"""SELECT time, series, {_STATS} FROM ({_LONG}) WHERE value IS NOT NULL AND
    (abs(date_diff('day', DATE '1999-01-01', time::DATE)) <= 2 OR date_diff('day', time::DATE, DATE '2001-10-31') BETWEEN 0 AND 2) GROUP BY 1, 2""")
def edge_day_stats(spark, sf):
    return distrib.distribution_stats(distrib.edge_days(long_periods(spark, sf), "1999-01-01", "2001-10-31"), ["time", "series"])


def hist_sql(rel: str, keys: str, bins: int, lo: str, hi: str) -> str:
    """Histogram of relation (keys, value) over [lo, hi]; lo and hi may be columns."""
    return f"""WITH h AS (SELECT {keys}, {lo} AS lo, {hi} AS hi, least(CAST(floor((value - {lo}) * {float(bins)} / ({hi} - {lo})) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM {rel} WHERE value BETWEEN {lo} AND {hi} GROUP BY ALL)
    SELECT {keys}, bin, lo + (bin + 0.5) * ((hi - lo) / {bins}) AS center, n, n / (sum(n) OVER (PARTITION BY {keys}) * ((hi - lo) / {bins})) AS density FROM h"""


@query("series:s bin:i center:f n:l density:f", "D25", hist_sql(f"({_LONG})", "series", 100, "4.9937::DOUBLE", "45.0011::DOUBLE"))
def histogram_fixed_range(spark, sf):
    return distrib.histogram(long_periods(spark, sf), ["series"], 100, 4.9937, 45.0011)


@query("period:s series:s bin:i center:f n:l density:f", "D25", hist_sql(
    f"(SELECT *, min(value) OVER (PARTITION BY period, series) AS mn, max(value) OVER (PARTITION BY period, series) AS mx FROM ({_LONG}))", "period, series", 50, "mn", "mx"))
def histogram_own_range(spark, sf):
    return distrib.histogram(long_periods(spark, sf), ["period", "series"], 50)


@query("lo:f hi:f", "D26", f"SELECT mn - (mx - mn) * 0.02 AS lo, mx + (mx - mn) * 0.02 AS hi FROM (SELECT min(value) AS mn, max(value) AS mx FROM ({_LONG}))")
def common_range(spark, sf):
    return distrib.data_range(long_periods(spark, sf))


_KERNEL = "(VALUES " + ", ".join(f"({i - 6}, {w!r}::DOUBLE)" for i, w in enumerate(distrib.kernel())) + ") k(off, w)"


def smooth_sql(hist: str, keys: str, bins: int) -> str:
    return f"""WITH hh AS ({hist}), b AS (SELECT DISTINCT {keys}, CAST(r.i AS INTEGER) AS bin FROM hh, range({bins}) r(i))
    SELECT b.*, coalesce((SELECT sum(w * density) FROM hh JOIN {_KERNEL} ON hh.bin + off = b.bin WHERE {' AND '.join(f'hh.{k.strip()} = b.{k.strip()}' for k in keys.split(','))}), 0) AS density FROM b"""


_SERIES_HIST = hist_sql(f"({_LONG})", "series", 100, "4.9937::DOUBLE", "45.0011::DOUBLE")


@query("series:s bin:i density:f", "D27", smooth_sql(_SERIES_HIST, "series", 100))
def smoothed_density(spark, sf):
    return distrib.smooth(distrib.histogram(long_periods(spark, sf), ["series"], 100, 4.9937, 45.0011), ["series"], 100)


@query("series:s bin:i difference:f", "D28", f"""WITH sm AS ({smooth_sql(_SERIES_HIST, 'series', 100)})
    SELECT a.series, a.bin, a.density - r.density AS difference FROM sm a JOIN sm r ON a.bin = r.bin AND r.series = 'obs' WHERE a.series <> 'obs'""")
def density_difference(spark, sf):
    curve = distrib.smooth(distrib.histogram(long_periods(spark, sf), ["series"], 100, 4.9937, 45.0011), ["series"], 100)
    return distrib.density_difference(curve, "obs")


@query("series:s q05_bias:f q50_bias:f q95_bias:f", "D28", f"""WITH q AS (SELECT series, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.95) AS c FROM ({_LONG}) GROUP BY 1)
    SELECT s.series, s.a - o.a AS q05_bias, s.b - o.b AS q50_bias, s.c - o.c AS q95_bias FROM q s, q o WHERE o.series = 'obs' AND s.series <> 'obs'""")
def quantile_bias(spark, sf):
    return distrib.quantile_bias(long_periods(spark, sf), "obs")


@query("curve:s mean:f std:f n:l", "D38", f"SELECT series AS curve, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM ({_LONG}) GROUP BY 1")
def curve_summary(spark, sf):
    return distrib.curve_summary(long_periods(spark, sf).withColumnRenamed("series", "curve"))


@query("iy:i ix:i series:s cold_days_bias:f warm_days_bias:f", "D39", """
    WITH s AS (SELECT iy, ix, avg((obs < 10)::INT) AS oc, avg((obs > 40)::INT) AS ow, avg((raw < 10)::INT) AS rc, avg((raw > 40)::INT) AS rw, avg((bc < 10)::INT) AS bc_, avg((bc > 40)::INT) AS bw FROM daily_points GROUP BY 1, 2)
    SELECT iy, ix, 'raw' AS series, rc - oc AS cold_days_bias, rw - ow AS warm_days_bias FROM s UNION ALL SELECT iy, ix, 'bc', bc_ - oc, bw - ow FROM s""")
def threshold_days_bias(spark, sf):
    long = S.daily_points(spark, sf).unpivot(["time", "iy", "ix"], ["obs", "raw", "bc"], "series", "value")
    return distrib.threshold_days_bias(long, 10.0, 40.0)


def _trend(stat: str, name: str) -> str:
    f = {(p, s): stat.format(v=s, w=f"period = '{p}'") for p in ("test_hist", "test_future") for s in ("raw", "bc")}
    return f"({f['test_future', 'bc']} - {f['test_hist', 'bc']}) - ({f['test_future', 'raw']} - {f['test_hist', 'raw']}) AS {name}_trend_bias"


@query("iy:i ix:i mean_trend_bias:f q05_trend_bias:f q95_trend_bias:f cold_days_trend_bias:f warm_days_trend_bias:f", "D40", "SELECT iy, ix, " + ", ".join([
    _trend("avg({v}) FILTER ({w})", "mean"), _trend("quantile_cont({v}, 0.05) FILTER ({w})", "q05"), _trend("quantile_cont({v}, 0.95) FILTER ({w})", "q95"),
    _trend("avg(({v} < 10)::INT) FILTER ({w})", "cold_days"), _trend("avg(({v} > 40)::INT) FILTER ({w})", "warm_days")]) + " FROM period_points GROUP BY 1, 2")
def future_trend_bias(spark, sf):
    p = S.period_points(spark, sf).where("period <> 'train_hist'")
    period = F.when(F.col("period") == "test_future", "future").otherwise("hist")
    long = p.withColumnRenamed("bc", "corrected").withColumn("period", period).unpivot(["period", "time", "iy", "ix"], ["raw", "corrected"], "series", "value")
    return distrib.future_trend_bias(long, 10.0, 40.0)


@query("half:s bin:i center:f n:l density:f", "D41", hist_sql(
    "(SELECT CASE WHEN month(time) BETWEEN 3 AND 8 THEN 'MAMJJA' ELSE 'SONDJF' END AS half, obs AS value FROM monthly_points)", "half", 40, "0.0007::DOUBLE", "50.0011::DOUBLE"))
def seasonal_monthly_histogram(spark, sf):
    m = S.monthly_points(spark, sf).select(timeops.half_year("time").alias("half"), F.col("obs").alias("value"))
    return distrib.histogram(m, ["half"], 40, 0.0007, 50.0011)


_FIVE = """(SELECT series, value + 260 AS value FROM (SELECT time, 'obs' AS series, obs AS value FROM daily_points UNION ALL SELECT time, 'raw', raw FROM daily_points UNION ALL SELECT time, 'bc', bc FROM daily_points
    UNION ALL SELECT time, 'ml', ml FROM daily_points UNION ALL SELECT time, 'reanalysis', (raw + bc) / 2 FROM daily_points) WHERE date_diff('day', DATE '1995-01-01', time::DATE) % 7 = 0 AND time >= '1995-01-01')"""


@query("series:s bin:i density:f mean:f", "D48", f"""WITH sm AS ({smooth_sql(hist_sql(_FIVE, 'series', 100, '260.0::DOUBLE', '310.0::DOUBLE'), 'series', 100)})
    SELECT * FROM sm JOIN (SELECT series, avg(value) AS mean FROM {_FIVE} GROUP BY 1) USING (series)""")
def multi_source_density(spark, sf):
    p = timeops.every_n_days(S.daily_points(spark, sf), "1995-01-01", 7).withColumn("reanalysis", (F.col("raw") + F.col("bc")) / 2)
    long = p.unpivot(["time"], ["obs", "raw", "bc", "ml", "reanalysis"], "series", "value").withColumn("value", F.col("value") + 260)
    curve, mean = distrib.series_densities(long)
    return curve.join(mean, "series")
