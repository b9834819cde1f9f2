"""Grouped and cogrouped per-cell models, and the distributed ranks and chains of the correction operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.columns import finite
from gridloom.operators import biascorr, cellwise, ecdf


def points(spark, n=400):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"iy": np.repeat(np.arange(4), n // 4), "time": np.tile(np.arange(n // 4), 4), "x": rng.normal(size=n)})
    pdf["y"] = pdf.iy * pdf.x + pdf.iy - 1 + rng.normal(scale=0.1, size=n)
    pdf.loc[pdf.index % 9 == 0, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("iy", F.when(F.col("iy") < 3, F.col("iy").cast("int")))


def test_a_line_per_group(spark):
    pdf, df = points(spark)
    got = {r.iy: r for r in cellwise.fit_per_group(df, ["iy"], cellwise.line_fit("x", "y"), cellwise.LINE, ["x", "y"], ["time"]).collect()}
    assert set(got) == {0, 1, 2, None}
    for k, rows in pdf.dropna().groupby("iy"):
        slope, intercept = np.polyfit(rows.x, rows.y, 1)
        r = got[k if k < 3 else None]
        assert (r.slope, r.intercept, r.n) == (pytest.approx(slope), pytest.approx(intercept), len(rows))


def test_declined_groups_and_frames(spark):
    _, df = points(spark)
    few = cellwise.fit_per_group(df.where("time < 3 or iy = 1"), ["iy"], cellwise.line_fit("x", "y", 10), cellwise.LINE, ["x", "y"])
    assert [r.iy for r in few.collect()] == [1]
    two = cellwise.fit_per_group(df, ["iy"], lambda rows: pd.DataFrame({"k": [0, 1], "m": [rows.x.min(), rows.x.max()]}), "k long, m double", ["x"])
    assert two.count() == 8
    assert cellwise.fit_per_group(df.limit(0), ["iy"], cellwise.line_fit("x", "y"), cellwise.LINE, ["x", "y"]).count() == 0


def test_order_reaches_the_fit(spark):
    _, df = points(spark)
    first = cellwise.fit_per_group(df.orderBy(F.rand(1)), ["iy"], lambda rows: {"first": int(rows["time"].iloc[0])}, "first long", ["time"], ["time"])
    assert {r["first"] for r in first.collect()} == {0}


def test_cogrouped_prediction(spark):
    pdf, df = points(spark)
    fitted = cellwise.fit_per_group(df.where("iy <> 2"), ["iy"], cellwise.line_fit("x", "y"), cellwise.LINE, ["x", "y"])
    got = cellwise.predict_per_group(fitted, df.where("iy >= 1"), ["iy"], cellwise.line_predict("x", ["time"]), "time long, predicted double", ["time", "x"]).toPandas()
    assert len(got) == 200 and got[got.iy == 2].predicted.isna().all()
    one = got[got.iy == 1].sort_values("time")
    assert np.allclose(one.predicted, pdf[pdf.iy == 1].x, atol=0.2)


def test_an_oversized_group_raises_before_anything_is_handed_over(spark):
    _, df = points(spark)

    def never(rows):
        raise AssertionError("handed over")

    with pytest.raises(cellwise.OversizedGroup, match="iy=0: 100 rows"):
        cellwise.fit_per_group(df.where("iy = 0 or time < 5"), ["iy"], never, cellwise.LINE, ["x", "y"], max_rows=99)
    with pytest.raises(cellwise.OversizedGroup, match="bytes"):
        cellwise.fit_per_group(df, ["iy"], never, cellwise.LINE, ["x", "y"], max_bytes=1000)
    fitted = cellwise.fit_per_group(df, ["iy"], cellwise.line_fit("x", "y"), cellwise.LINE, ["x", "y"])
    with pytest.raises(cellwise.OversizedGroup):
        cellwise.predict_per_group(fitted, df, ["iy"], never, "p double", ["x"], max_rows=50)
    with pytest.raises(ValueError, match="key's name"):
        cellwise.fit_per_group(df, ["iy"], never, "iy int", ["x"])


@pytest.mark.parametrize("largest", [ecdf.LARGEST, 200, 3])
def test_ranked_values_whatever_the_buckets(spark, largest):
    """One pooled series of many values and one of few, with a null group; counted, summed and followed exactly."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["all"] * 900 + ["few"] * 60 + [None] * 40, "v": np.r_[rng.normal(size=600), np.full(300, 0.25), rng.integers(0, 3, 60), rng.normal(size=40)], "a": rng.integers(0, 2, 1000)})
    weights = {"n": F.lit(1), "a": F.col("a")}
    got = ecdf.ranked_values(spark.createDataFrame(pdf), ["g"], "v", weights, following=("a",), largest=largest).toPandas()
    for name, rows in pdf.groupby(pdf.g.fillna("-")):
        mine = got[got.g.fillna("-") == name].sort_values("v").reset_index(drop=True)
        want = rows.groupby("v").agg(n=("a", "size"), a=("a", "sum")).reset_index()
        assert np.array_equal(mine.v, want.v) and np.array_equal(mine.n, want.n) and np.array_equal(mine.a, want.a)
        assert np.array_equal(mine.n_before, want.n.cumsum() - want.n) and np.array_equal(mine.a_before, want.a.cumsum() - want.a)
        assert (mine.n_total == want.n.sum()).all() and (mine.a_total == want.a.sum()).all()
        assert np.array_equal(mine.next_value.fillna(9), want.v.shift(-1).fillna(9))
        following = want.v.where(want.a > 0).shift(-1).bfill()
        assert np.array_equal(mine.a_next.fillna(9), following.fillna(9))


def test_no_bucket_above_the_limit(spark):
    """One pooled series of 20,000 values: cut twice where one cut leaves too much."""
    df = spark.range(20_000).selectExpr("'all' as g", "cast(id as double) as v")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    placed, names = ecdf._buckets(counts, ["g"], "v", 100)
    sizes = [r["count"] for r in placed.groupBy("g", *names).count().collect()]
    assert len(names) == 2 and max(sizes) <= 100 and sum(sizes) == 20_000
    q = ecdf.exact_quantiles(df, ["g"], "v", [0.0, 0.333, 0.5, 1.0], largest=100).first().quantiles
    assert q == pytest.approx([0.0, 0.333 * 19_999, 9_999.5, 19_999.0])


@pytest.mark.parametrize("largest", [ecdf.LARGEST, 7])
def test_ranks_under_ties(spark, largest):
    """A third of all values are equal; ranks equal those of a plain sort by value and time."""
    pdf = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 30, "time": pd.to_datetime("2000-01-01") + pd.to_timedelta(np.random.default_rng(0).permutation(330), "h")})
    pdf["v"] = np.where(pdf.index % 3 == 0, 1.5, np.random.default_rng(2).integers(0, 90, 330) / 30)
    got = biascorr.rank_rows(spark.createDataFrame(pdf), ["g"], "v", largest).toPandas().sort_values(["g", "v", "time"])
    assert np.array_equal(got._rank, np.r_[np.arange(1, 301), np.arange(1, 31)])


def test_reordering_by_arrays_and_by_ranks(spark):
    """Ties in both orders, two cells, an uneven one."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"iy": 0, "ix": [0] * 60 + [1] * 7, "period": "test_hist", "time": pd.to_datetime("2000-01-01") + pd.to_timedelta(rng.permutation(67), "D")})
    for c in ("ru", "rv", "su", "sv"):
        pdf[c] = rng.integers(0, 9, 67) / 4
    both = spark.createDataFrame(pdf)
    a, b = (biascorr._reordered(both, ["iy", "ix"], n).toPandas().sort_values(["ix", "time"]).reset_index(drop=True) for n in (100, 50))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])
    for axis in "uv":
        for ix, g in pdf.groupby("ix"):
            want = pd.Series(np.sort(g[f"s{axis}"]), index=g.sort_values([f"r{axis}", "time"]).time)
            assert a[a.ix == ix].set_index("time")[f"corrected_{axis}"].to_dict() == want.to_dict()


def pair_rows(spark, future=2.0):
    rng = np.random.default_rng(5)
    frames = []
    for period, year in (("train_hist", 1990), ("test_hist", 1995), ("test_future", 2050)):
        n = 60
        a, b, c = rng.normal(size=(3, n))
        shift = future if period == "test_future" else 0.0
        frames.append(pd.DataFrame({"period": period, "time": pd.date_range(f"{year}-01-01", periods=n), "iy": 0, "ix": 0, "obs_u": a, "obs_v": 0.9 * a + 0.3 * b, "sim_u": b + 1 + shift, "sim_v": 2 * c + shift}))
    one = pd.concat(frames)
    few = one.assign(ix=1)
    few.loc[(few.period == "train_hist") & (few.time.dt.dayofyear > 9), "obs_u"] = np.nan
    pdf = pd.concat([one, few], ignore_index=True)
    pdf.loc[pdf.time.dt.dayofyear == 7, "sim_v"] = np.nan
    values = {c: finite(c) for c in ("obs_u", "obs_v", "sim_u", "sim_v")}
    return pdf, spark.createDataFrame(pdf).withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int"), **values})


def test_chain_guards_masks_and_unseen_data(spark):
    pdf, df = pair_rows(spark)
    chain = biascorr.fit_mbcn(df, angles=[0.3, 1.2], steps=20)
    assert sorted({(r.step, r.period, r.ix) for r in chain.collect()}) == [(k, p, 0) for k in (-1, 0, 1) for p in ("test_hist", "train_hist")]
    out = biascorr.predict_mbcn(chain, df, steps=20).toPandas()
    assert len(out) == len(pdf) and out[out.ix == 1].corrected_u.isna().all()
    mine = out[out.ix == 0]
    gap = mine.sim_v.isna()
    assert mine.corrected_u.isna().equals(gap) and mine.corrected_v.isna().equals(gap) and gap.sum() == 3
    # The future is mapped by the historical fit: its shift stays, whatever the future itself looks like.
    mean = mine.groupby("period").corrected_u.mean()
    assert mean["test_future"] - mean["test_hist"] > 1
    assert mean["train_hist"] == pytest.approx(mine[mine.period == "train_hist"].obs_u.mean(), abs=0.1)
    # Rows that no fit has seen, under a period of their own.
    later = df.where("period = 'test_future' and ix = 0").withColumn("period", F.lit("late"))
    again = biascorr.predict_mbcn(chain, later, follows={"late": "test_hist"}, steps=20).toPandas().sort_values("time")
    assert np.allclose(again.corrected_v, mine[mine.period == "test_future"].sort_values("time").corrected_v, equal_nan=True)


def test_a_stored_chain_gives_the_same(spark, tmp_path):
    _, df = pair_rows(spark)
    chain = biascorr.fit_mbcn(df, n_rotations=1, seed=4, steps=10)
    chain.write.parquet(str(tmp_path / "chain"))
    key = ["ix", "period", "time"]
    a, b = (biascorr.predict_mbcn(c, df, steps=10).toPandas().sort_values(key) for c in (chain, spark.read.parquet(str(tmp_path / "chain"))))
    c = biascorr.mbcn(df, n_rotations=1, seed=4, steps=10).toPandas().sort_values(key)
    assert np.array_equal(a.corrected_u, b.corrected_u, equal_nan=True) and np.array_equal(a.corrected_u, c.corrected_u, equal_nan=True)


def test_cells_handed_over_whole_give_the_same(spark, monkeypatch):
    """Small cells by arrays and large ones by counting; null cells, periods and times, periods without values, and other columns."""
    pdf, df = pair_rows(spark)
    odd = df.where("ix = 0").limit(6).withColumns({"iy": F.lit(None).cast("int")}).unionByName(
        df.where("ix = 0").limit(3).withColumn("period", F.lit(None).cast("string"))).unionByName(
        df.where("ix = 0 and period = 'test_future' and time < '2050-01-03'").withColumn("time", F.lit(None).cast("timestamp"))).unionByName(
        df.where("ix = 0 and period = 'test_future'").withColumns({"ix": F.lit(2), "sim_u": F.lit(None).cast("double")})).unionByName(
        df.where("ix = 0").withColumns({"ix": F.lit(2), "sim_v": F.round("sim_v", 0)}).where("period <> 'test_future'"))
    rows = df.unionByName(odd).withColumn("note", F.concat(F.lit("n"), F.col("ix"))).localCheckpoint()
    key = ["ix", "iy", "period", "time", "sim_u", "obs_u"]
    found, written = [], []
    monkeypatch.setattr(biascorr, "materialise", lambda t, name="step", f=biascorr.materialise: (written.append(name), f(t, name))[1])
    for largest in (10, 40_000):
        chain = biascorr.fit_mbcn(rows, angles=[0.3, 1.2], steps=20, largest=largest)
        tables = chain.orderBy("step", "ix", "period").toPandas()
        out = biascorr.predict_mbcn(chain, rows, steps=20, largest=largest)
        found.append((chain.columns, out.dtypes, tables, out.toPandas().sort_values(key).reset_index(drop=True), len(written)))
    (names, kinds, chain, out, many), (names2, kinds2, chain2, out2, all_of_them) = found
    assert names == names2 and kinds == kinds2 and all_of_them == many > 6  # small cells need no table between the steps
    assert len(chain) == len(chain2) == 12 and (chain[["step", "angle", "period", "ix"]] == chain2[["step", "angle", "period", "ix"]]).all(None)
    for c in ("xs_u", "zs_u", "xs_v", "zs_v"):
        assert np.allclose(np.stack(chain[c]), np.stack(chain2[c]), rtol=0, atol=1e-12)
    assert len(out) == len(out2) == rows.count() and out.note.equals(out2.note)
    assert out2[out2.ix == 2].corrected_u.notna().sum() > 100
    for c in ("corrected_u", "corrected_v"):
        assert np.allclose(out[c], out2[c], rtol=0, atol=1e-9, equal_nan=True)


def test_groups_are_whole_across_batches(spark):
    """Groups end anywhere in the batches or go on over several; null and NaN keys, and nulls among whole numbers, stay each its own."""
    rows = [(k, None if k % 5 == 0 else k // 7 * 1.5 if k % 5 < 4 else float("nan"), (1 << 60) + k, None if k == 3 else k % 2 == 0) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, g double, big long, odd boolean").withColumn("iy", F.when(F.col("id") % 3 > 0, F.lit((1 << 60)) + F.col("id") % 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        fits = cellwise.fit_per_group(df, ["g", "iy"], lambda r: {"least": int(r.big.min()), "n": len(r), "kind": f"{r.big.dtype} {r.odd.dtype}"},
                                      "least long, n long, kind string", ["big", "odd"], ["id"]).collect()
        some = df.withColumn("big", F.when(F.col("id") != 8, F.col("big")))
        sums = cellwise.predict_per_group(df.groupBy("iy").agg(F.min("big").alias("low")), some, ["iy"], lambda p, r: pd.DataFrame({"id": r.id, "up": r.big - p.low.iloc[0]}), "id long, up double", ["id", "big"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, g, big, _ in rows:
        want.setdefault((str(g), (1 << 60) + k % 3 if k % 3 else None), []).append(big)
    # A NaN key leaves Python as null, as it always did; its group is not that of the nulls.
    assert sorted((r.least, r.n) for r in fits) == sorted((min(v), len(v)) for v in want.values())
    assert {r.kind for r in fits if r.n and (1 << 60) + 3 != r.least} >= {"int64 bool"}
    assert {r.iy for r in fits} == {None, (1 << 60) + 1, (1 << 60) + 2}
    assert sorted(r.id for r in sums) == list(range(90))
    assert {(r.id, r.up) for r in sums if r.id % 3 != 2} == {(k, float(k - k % 3)) for k in range(90) if k % 3 != 2}


def test_many_small_groups_are_handed_over_together(spark):
    """A batch of many groups, not one of each: the plan has no grouped or cogrouped map."""
    _, df = points(spark)
    fitted = cellwise.fit_per_group(df, ["iy"], cellwise.line_fit("x", "y"), cellwise.LINE, ["x", "y"])
    got = cellwise.predict_per_group(fitted, df, ["iy"], cellwise.line_predict("x", ["time"]), "time long, predicted double", ["time", "x"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "GroupsInPandas" not in plan
