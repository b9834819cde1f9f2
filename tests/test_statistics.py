import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import biascorr, compare, distrib, skill, value
from gridloom.operators.ecdf import exact_quantiles, quantile_table, wasserstein
from gridloom.operators.ordering import calendar_bucket, positions, previous_row

START = dt.datetime(1999, 11, 20)


def series(spark, n_days=60, cells=3, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    rows = [(START + dt.timedelta(days=d), 0, c, float(np.round(rng.normal(10 + c, 3), 1)), float(rng.normal(11 + c, 2))) for d in range(n_days) for c in range(cells) if rng.random() > missing]
    pdf = pd.DataFrame(rows, columns=["time", "iy", "ix", "obs", "pred"])
    return pdf, spark.createDataFrame(pdf).withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int")})


def hot(spark):
    """One group holds nearly all rows, in few distinct values and a long tail."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot"] * 3000 + ["one"] + ["few"] * 7, "v": np.concatenate([np.round(rng.exponential(1, 2900), 1), rng.normal(1e6, 1, 100), [5.0], rng.normal(0, 1, 7)])})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_are_exact_with_a_hot_group(spark):
    pdf, df = hot(spark)
    probs = [0, 0.05, 0.5, 0.93, 0.99, 1]
    got = {r.k: r.quantiles for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    table = {r.k: (r.nodes, r.n) for r in quantile_table(df, ["k"], "v", 20).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(g.v, probs).tolist(), rel=1e-12)
        assert table[k][0] == pytest.approx(np.quantile(g.v, np.arange(21) / 20).tolist(), rel=1e-12) and table[k][1] == len(g)
    assert exact_quantiles(df, [], "v", probs).first().quantiles == pytest.approx(np.quantile(pdf.v, probs).tolist())


def test_small_groups_sorted_as_arrays_give_the_same_quantiles(spark):
    """Many small groups, one of them without values, one with a null key: by arrays as by counts, and from no more than one shuffle."""
    pdf, _ = hot(spark)
    df = spark.createDataFrame([(k, v) for k, v in zip(pdf.k, pdf.v.astype(float))] + [("none", None), (None, 2.0), (None, None), (None, 4.0)], "k string, v double")
    probs = [0, 0.05, 0.5, 0.93, 1]
    for cells in (lambda **k: exact_quantiles(df, ["k"], "v", probs, **k), lambda **k: quantile_table(df, ["k"], "v", 20, **k)):
        arrays, counts, cut = ({r[0]: r[1:] for r in cells(**k).collect()} for k in ({"cells": True}, {}, {"cells": True, "largest": 100}))
        assert arrays == counts and set(arrays) == {"hot", "one", "few", None}
        assert {k: v[0] for k, v in cut.items()} == {k: pytest.approx(v[0]) for k, v in counts.items()}
        assert cells(cells=True)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_wasserstein_against_brute_force(spark):
    pdf, df = hot(spark)
    pdf["first"] = np.arange(len(pdf)) % 3 == 0
    df = spark.createDataFrame(pdf[pdf.k == "hot"])
    a, b = (np.sort(pdf[(pdf.k == "hot") & (pdf["first"] == f)].v) for f in (True, False))
    allv = np.sort(np.concatenate([a, b]))
    want = np.sum(np.abs(np.searchsorted(a, allv[:-1], "right") / len(a) - np.searchsorted(b, allv[:-1], "right") / len(b)) * np.diff(allv))
    assert wasserstein(df, ["k"], "v", F.col("first")).first().wasserstein == pytest.approx(want)


def test_bucketed_order_equals_plain_order(spark):
    pdf, df = series(spark)
    pdf = pdf.sort_values(["ix", "time"]).reset_index(drop=True)
    prev = previous_row(df, ["ix"], "time", ["obs"], unit="month").orderBy("ix", "time").toPandas()
    assert np.allclose(prev.obs_prev.astype(float), pdf.groupby("ix").obs.shift(), equal_nan=True)
    pos = positions(df, ["ix"], "time", calendar_bucket("time", "month")).orderBy("ix", "time").toPandas()
    assert (pos.position.values == pdf.groupby("ix").cumcount() + 1).all()


def brute_summary(pdf):
    out = {}
    for name, months in (("all", range(1, 13)), ("summer", (6, 7, 8)), ("winter", (12, 1, 2))):
        sub = pdf[pdf.time.dt.month.isin(months)]
        if sub.empty:
            out[name] = None
            continue
        e = sub.assign(e=sub.pred - sub.obs)
        g = pdf.sort_values("time").assign(dp=lambda d: d.groupby("ix").pred.diff().abs(), d_o=lambda d: d.groupby("ix").obs.diff().abs())
        g = g[g.time.dt.month.isin(months)].groupby("ix")[["dp", "d_o"]].mean()
        out[name] = (np.sqrt((e.e**2).groupby(e.time).mean()).mean(), np.sqrt((e.e**2).groupby(e.ix).mean()).mean(), e.e.groupby(e.ix).mean().mean(), (g.dp - g.d_o).mean())
    return out


def test_summary_by_season_with_an_empty_season(spark):
    pdf, df = series(spark)
    want = brute_summary(pdf)
    got = {r.season: r for r in skill.skill_summary(df).collect()}
    assert set(got) == {"all", "summer", "winter"} and want["summer"] is None and got["summer"].rmse_temporal_mean is None
    for s in ("all", "winter"):  # winter holds winter days only, and differs from the whole
        r = got[s]
        assert (r.rmse_temporal_mean, r.rmse_spatial_mean, r.bias_spatial_mean, r.variability_mean) == pytest.approx(want[s])
    assert got["winter"].rmse_spatial_mean != pytest.approx(got["all"].rmse_spatial_mean)


def test_monthly_maps_divide_by_months(spark):
    pdf, df = series(spark)
    m = pdf.assign(m=pdf.time.dt.to_period("M")).groupby(["m", "ix"])[["obs", "pred"]].mean().reset_index()
    want = ((m.pred - m.obs).groupby(m.ix).mean()).mean()
    assert {r.season: r for r in skill.monthly_skill_summary(df).collect()}["all"].bias_spatial_mean == pytest.approx(want)


def test_increments_do_not_wrap_and_respect_gaps(frame):
    rows = [(dt.datetime(2000, 1, d), 0, 0, v) for d, v in ((1, 1.0), (2, 4.0), (5, 2.0))]
    df = frame(rows, "time timestamp, iy int, ix int, value double")
    assert [r.d_value for r in skill.increments(df).orderBy("time").collect()] == [None, 3.0, -2.0]
    assert [r.d_value for r in skill.increments(df, max_gap_days=1).orderBy("time").collect()] == [None, 3.0, None]


def test_lag1_masks_both_days_jointly(spark):
    pdf, df = series(spark)
    want = []
    for _, g in pdf.sort_values("time").groupby("ix"):
        want.append(np.corrcoef(g.obs[:-1], g.obs[1:])[0, 1])
    assert value.lag1_autocorrelation(df).first().autocorr_obs_mean == pytest.approx(np.mean(want))


def test_constant_series_gives_null_correlation(frame):
    df = frame([(dt.datetime(2000, 1, 1), 0, i, 5.0, float(i)) for i in range(3)], "time timestamp, iy int, ix int, obs double, pred double")
    assert skill.skill_by_time(df).first().corr is None


def test_spells(frame):
    base = dt.datetime(1999, 12, 29)
    flags = [1, 1, 0, 1, 1, 1, 1, 0]  # one run crosses the year
    df = frame([(base + dt.timedelta(days=i), 0, 0, float(f)) for i, f in enumerate(flags)] + [(base, 0, 1, 0.0)], "time timestamp, iy int, ix int, value double")
    got = {r.ix: r.mean_spell for r in value.mean_spell_length(df, 0.5).collect()}
    assert got == {0: 3.0, 1: 0.0}


def test_seeded_sample_keeps_pairs_and_is_stable(spark):
    pdf, df = series(spark, 10, 40, missing=0)
    a, b = (value.seeded_sample(df, 7, 3).toPandas() for _ in range(2))
    assert a.groupby("time").size().eq(7).all() and a.sort_values(["time", "ix"]).reset_index(drop=True).equals(b.sort_values(["time", "ix"]).reset_index(drop=True))
    assert len(a.merge(pdf, on=["time", "iy", "ix", "obs", "pred"])) == 70
    assert value.seeded_sample(df.repartition(7), 7, 3).join(df.sparkSession.createDataFrame(a), ["time", "ix"]).count() == 70


def test_density_and_smoothing(spark):
    pdf, df = series(spark, 200)
    d = df.select(F.lit("s").alias("series"), F.col("obs").alias("value"))
    hist = distrib.histogram(d, ["series"], 20, 0.0, 20.0)
    counts, _ = np.histogram(pdf.obs, bins=20, range=(0, 20))
    dens = counts / counts.sum()
    got = {r.bin: r.density for r in hist.collect()}
    assert [got.get(i, 0.0) for i in range(20)] == pytest.approx(dens.tolist())
    k = np.array(distrib.kernel())
    assert len(k) == 13
    smooth = [r.density for r in distrib.smooth(hist, ["series"], 20).orderBy("bin").collect()]
    assert smooth == pytest.approx(np.convolve(dens, k, mode="same").tolist())
    assert distrib.histogram(d.limit(1).withColumn("value", F.lit(20.0)), ["series"], 20, 0.0, 20.0).first().bin == 19


def test_partition_count_does_not_change_results(spark):
    _, df = series(spark)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(value.value_summary(df.repartition(int(n))).first().asDict())
    spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert got[0] == pytest.approx(got[1], rel=1e-12)


def test_metadata_fill(frame):
    t = frame([(1, ""), (2, "K"), (3, None)], "w int, unit string")
    assert [r.unit for r in compare.fill_metadata(t, ["unit"], "w").orderBy("w").collect()] == ["K", "K", "K"]


# --- distribution mapping ------------------------------------------------------------------------------

def make_bundle(spark, shift=0.0, scale=1.0, n=240, seed=5, future_shift=0.0):
    rng = np.random.default_rng(seed)
    frames = []
    for period, year in (("train_hist", 1990), ("test_hist", 2000), ("test_future", 2010)):
        obs = rng.normal(15, 4, n)
        sim = obs * scale + shift + (future_shift if period == "test_future" else 0.0)
        frames.append(pd.DataFrame({"period": period, "time": pd.date_range(f"{year}-01-01", periods=n), "iy": 0, "ix": 0, "obs": obs, "sim": sim}))
    pdf = pd.concat(frames)
    pdf.loc[pdf.period == "test_future", "obs"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int"), "obs": F.when(~F.isnan("obs"), F.col("obs"))})
    return pdf, df


def test_cdft_identity_and_constant_shift(spark):
    pdf, df = make_bundle(spark)
    out = biascorr.cdft(df).toPandas()
    assert np.abs(out.corrected - out.sim).max() < 1e-9
    pdf, df = make_bundle(spark, shift=3.0, future_shift=2.0)
    out = biascorr.cdft(df).toPandas()
    # The bias of 3 goes, the change of 2 in the future stays.
    assert np.abs(out.corrected - (out.sim - 3.0)).max() < 1e-9


def test_cdft_is_monotone_and_corrects_the_spread(spark):
    pdf, df = make_bundle(spark, shift=2.0, scale=0.5)
    out = biascorr.cdft(df).toPandas()
    for _, g in out.groupby("period"):
        assert (np.diff(g.sort_values("sim").corrected) >= -1e-9).all()
    hist = out[out.period == "test_hist"]
    assert abs(hist.corrected.std() - hist.obs.std()) < abs(hist.sim.std() - hist.obs.std()) / 3


def test_guards(spark):
    pdf, df = make_bundle(spark, shift=1.0)
    holes = df.withColumn("sim", F.when(F.dayofmonth("time") != 3, F.col("sim")))
    out = biascorr.guarded_cdft(holes).toPandas()
    assert out.corrected.isna().equals(out.sim.isna()) and out.corrected.notna().sum() > 600
    few = df.where("period <> 'train_hist' or day(time) = 1 and month(time) < 9")
    assert biascorr.guarded_cdft(few).where("corrected is not null").count() == 0


def test_running_window_follows_the_season(spark):
    pdf, df = make_bundle(spark, n=365)
    seasonal = df.withColumn("sim", F.col("obs") + F.when(F.month("time") <= 6, 5.0).otherwise(-5.0)).where("period <> 'test_future'")
    out = biascorr.running_window_cdft(seasonal, width=61, step=31, steps=20).where("period = 'test_hist' and month(time) in (2, 3, 4, 9, 10, 11)").toPandas()
    assert abs((out.corrected - out.obs)[out.time.dt.month < 6].mean()) < 1.5 and abs((out.corrected - out.obs)[out.time.dt.month > 6].mean()) < 1.5


def test_two_variable_correction_restores_dependence(spark):
    rng = np.random.default_rng(2)
    frames = []
    for period, year in (("train_hist", 1990), ("test_hist", 2000)):
        n = 200
        a, b, c = rng.normal(size=(3, n))
        frames.append(pd.DataFrame({"period": period, "time": pd.date_range(f"{year}-01-01", periods=n), "iy": 0, "ix": 0, "obs_u": a, "obs_v": 0.9 * a + 0.3 * b, "sim_u": b + 1, "sim_v": 2 * c}))
    df = spark.createDataFrame(pd.concat(frames)).withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int")})
    df = df.withColumn("sim_u", F.when(F.dayofyear("time") != 9, F.col("sim_u")))
    a = biascorr.mbcn(df, n_rotations=4, seed=1, steps=50).toPandas().sort_values("time")
    hist = a[a.period == "train_hist"].dropna()
    assert abs(np.corrcoef(hist.sim_u, hist.sim_v)[0, 1]) < 0.3 < 0.6 < np.corrcoef(hist.corrected_u, hist.corrected_v)[0, 1]
    assert abs(hist.corrected_u.mean() - hist.obs_u.mean()) < 0.1 and a.corrected_u.isna().equals(a.sim_u.isna())
    assert biascorr.rotation_angles(4, 1) == biascorr.rotation_angles(4, 1)


def test_gamma_fit_and_cdf(spark):
    from gridloom.functions.gamma import regularised_lower_gamma
    import math

    rng = np.random.default_rng(0)
    x = rng.gamma(3.0, 1 / 0.5, 20000) + 0.0
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "value": x[x > 1]}))
    r = biascorr.gamma_fit(df, ["k"], threshold=1.0).first()
    s = np.log(x[x > 1].mean()) - np.log(x[x > 1]).mean()
    h = 1e-4
    psi = (math.lgamma(r.alpha + h) - math.lgamma(r.alpha - h)) / (2 * h)
    assert math.log(r.alpha) - psi == pytest.approx(s, abs=1e-6) and r.beta == pytest.approx(r.alpha / x[x > 1].mean())
    assert biascorr.gamma_fit(df.withColumn("value", F.lit(0.5)), ["k"]).first().alpha is None
    # Integer shapes have a closed form.
    for a in (1, 2, 5):
        for t in (0.1, 1.0, 4.0, 20.0):
            want = 1 - math.exp(-t) * sum(t**i / math.factorial(i) for i in range(a))
            assert regularised_lower_gamma(np.array([float(a)]), np.array([t]))[0] == pytest.approx(want, abs=1e-10)


def test_gamma_weighted_mae(spark, frame):
    import math
    df = frame([(0, 0, 2.0, 1.0), (0, 0, 1.0, 2.0), (0, 0, None, 3.0)], "iy int, ix int, y double, pred double")
    params = frame([(0, 0, None, None)], "iy int, ix int, alpha double, beta double")
    want = ((1 + (1 - math.exp(-2)) ** 2 * 1) + 1) / 2
    assert biascorr.gamma_weighted_mae(df, params).first().gamma_mae == pytest.approx(want)


def test_repair_uses_values_before_any_repair(frame):
    df = frame([(1, 0, 0, 100.0), (1, 0, 1, 100.0), (1, 0, 2, 1.0), (1, 1, 0, None)], "time int, iy int, ix int, value double")
    got = {r.ix: r.value for r in biascorr.repair_aberrant(df, "value", threshold=50.0).where("iy = 0").collect()}
    assert got == {0: 100.0, 1: 67.0, 2: 1.0}


def test_training_check(frame):
    o = frame([(1, 0, 0)], "time int, iy int, ix int")
    biascorr.check_training(o, o)
    with pytest.raises(ValueError, match="1 unmatched"):
        biascorr.check_training(o, o.where("false"))
