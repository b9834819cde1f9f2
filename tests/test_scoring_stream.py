import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import normalise, samples, scoring
from gridloom.session import attach, materialise, shared_folder
from gridloom.streaming import skill_stream

DDL = "time timestamp, role string, channel string, iy int, ix int, value float"


def rows(days=3, ny=4, nx=5):
    out = []
    for d in range(days):
        t = dt.datetime(2000, 1, 1 + d)
        for j in range(ny):
            for i in range(nx):
                out.append((t, "x", "elevation", j, i, float(j)))
                out.append((t, "x", "tas input", j, i, 270.0 + d + j + 0.1 * i if (j, i) != (1, 1) else None))
                out.append((t, "y", "target", j, i, None if j == 0 else 1.0))
    return out


@pytest.fixture
def setup(frame):
    df = frame(rows(), DDL)
    stats = normalise.channel_statistics(df.where("role = 'x'"))
    mask = df.where("role = 'y' and value is not null").select("iy", "ix").distinct()
    return df, dict(channels=["elevation", "tas input"], stats=stats, target_channel="tas input", mask=mask, ny=4, nx=5)


def test_scores_come_back_in_place(setup):
    df, args = setup
    shapes = []

    def model(x, seed):
        assert x.shape[1:] == (2, 32, 32)
        return x[:, 1]

    got = {(r.time.day, r.iy, r.ix): r.value for r in scoring.score_fields(df, model, batch=2, **args).collect()}
    assert len(got) == 3 * 15 and not any(j == 0 for _, j, _ in got)
    low = 270.0
    for (d, j, i), v in got.items():
        want = low if (j, i) == (1, 1) else 270.0 + d - 1 + j + 0.1 * i
        assert v == pytest.approx(want, abs=1e-3)


def test_clipped_range_and_draws(setup):
    df, args = setup
    high = scoring.score_fields(df, lambda x, s: x[:, 1] * 0 + 5, output_range="minus_one_one", **args).agg(F.min("value"), F.max("value")).first()
    assert high[0] == high[1] == pytest.approx(275.4, abs=1e-3)

    def noisy(x, seed):
        return np.stack([np.full(x.shape[2:], np.random.default_rng(abs(int(s))).random()) for s in seed])

    one = scoring.score_fields(df, noisy, draws=6, seed=1, **args)
    a, b = one.agg(F.avg("value")).first()[0], one.agg(F.avg("value")).first()[0]
    assert a == pytest.approx(b) and 270 < a < 275.4


def test_single_date_has_errors(setup):
    df, args = setup
    out = scoring.score_date(df, "2000-01-02", model=lambda x, s: x[:, 1], **args).toPandas()
    assert set(out.time.dt.day) == {2} and (out.error - (out.prediction - out.target)).abs().max() < 1e-9


def test_stacking_puts_elevation_first(frame):
    f = frame([(dt.datetime(2000, 1, 1), 0, 0, 3.0)], "time timestamp, iy int, ix int, value double")
    static = frame([(0, 0, 42.0)], "iy int, ix int, value double")
    got = [(r.role, r.channel, r.value) for r in samples.stack_channels({"psl": f}, static, target=f.withColumn("value", F.lit(7.0))).collect()]
    assert got == [("x", "elevation", 42.0), ("x", "psl", 3.0), ("y", "target", 7.0)]


def test_packing_averages_duplicates(frame):
    t = dt.datetime(2000, 1, 1)
    df = frame([(t, "x", "c", 0, 1, 1.0), (t, "x", "c", 0, 1, 3.0), (t, "y", "t", 0, 0, 9.0)], DDL)
    r = samples.pack(df, ["c"], 2, 2).first()
    assert (r.idx, r.val) == ([1], [2.0])


def test_stream_equals_batch_as_files_arrive(spark, frame, tmp_path):
    source, sums, state = (str(tmp_path / n) for n in ("in", "sums", "state"))
    ddl = "time timestamp, run string, a double, b double"

    def day(d, k):
        return frame([(dt.datetime(2000, 1, d), "r", float(i), float(i * k)) for i in range(5)] + [(dt.datetime(2000, 1, d), "r", None, 1.0)], ddl)

    for d, k in ((1, 2), (2, 3), (1, 4)):  # the first day is updated by a later file
        day(d, k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        skill_stream.start_skill_stream(stream, sums, checkpoint=state).awaitTermination()
    got = skill_stream.skill_from_sums(skill_stream.latest_sums(spark, sums)).first()
    want = skill_stream.skill_from_sums(skill_stream.difference_sums(spark.read.schema(ddl).parquet(source))).first()
    assert got["count"] == want["count"] == 15 and got.rmse == pytest.approx(want.rmse) and got.max_abs_diff == want.max_abs_diff == 12.0


def test_empty_sums_give_only_a_count(spark, frame):
    df = frame([(dt.datetime(2000, 1, 1), "r", None, 1.0)], "time timestamp, run string, a double, b double")
    r = skill_stream.skill_from_sums(skill_stream.difference_sums(df)).first()
    assert r["count"] == 0 and r.rmse is None


def test_broadcast_only_after_a_size_check(spark):
    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(attach(big, small, "k")).lower()
    assert "broadcast" not in plan(attach(big, small, "k", max_rows=10)).lower()


def test_lineage_is_cut_in_the_configured_folder(spark, tmp_path):
    keep = spark.conf.get("spark.checkpoint.dir", None)
    df = materialise(spark.range(3).selectExpr("id * 2 as v"))
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert keep == spark.conf.get("spark.checkpoint.dir", None) and shared_folder(spark)
