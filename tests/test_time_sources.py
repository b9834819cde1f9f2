import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.operators import quality, timeops, value
from gridloom.operators.align import inventory_diff, require_rows
from gridloom.sources import archive_source, archives, catalog, readers, sinks

DAY = dt.datetime


def days(frame, *text):
    return frame([(DAY.fromisoformat(t),) for t in text], "time timestamp")


def test_frequencies(frame):
    rows = frame([("1D",), ("3hourly",), (None,), ("12h",)], "f string").select(L.frequency_label("f").alias("f"), L.frequency_token("f").alias("t")).collect()
    assert [tuple(r) for r in rows] == [("daily", "day"), ("3h", "3h"), ("daily", "day"), ("12h", "12h")]
    with pytest.raises(ValueError):
        L.step_hours("weekly")


def test_three_hour_range_and_tokens(frame):
    spans = frame([(dt.date(2000, 1, 1), dt.date(2000, 1, 1))], "a date, b date")
    tokens = [r[0] for r in L.times_between(spans, "a", "b", "3h").orderBy("time").select(L.time_token("time", "3h")).collect()]
    assert tokens[0] == "2000010100" and tokens[-1] == "2000010121" and len(tokens) == 8


def test_date_groups_split_at_year(frame):
    d = days(frame, "1984-12-30", "1984-12-31", "1985-01-01", "1985-01-02").withColumn("source", F.lit("f"))
    got = [r.group_id for r in timeops.consecutive_groups(d, "source").orderBy("time").collect()]
    assert got == [1, 1, 2, 2]


def test_resample_refuses_finer(frame):
    with pytest.raises(ValueError, match="finer"):
        timeops.resample(days(frame, "2000-01-01"), [], "daily", "3h")


def test_exact_time_else_first_of_day(frame):
    field = frame([(DAY(2000, 1, 1, 6), 0, 0, 1.0), (DAY(2000, 1, 1, 12), 0, 0, 2.0), (DAY(2000, 1, 2, 6), 0, 0, 3.0)], "time timestamp, iy int, ix int, value double")
    ask = frame([(DAY(2000, 1, 1, 12),), (DAY(2000, 1, 2),), (DAY(2000, 1, 3),)], "at timestamp")
    assert {r["at"].day: r["value"] for r in timeops.select_times(field, ask).collect()} == {1: 2.0, 2: 3.0}
    assert [r["at"].day for r in timeops.missing_times(field, ask).collect()] == [3]


def test_split_leaves_out_the_day_before_each_boundary(frame):
    t = frame([(DAY(2000, 1, 1) + dt.timedelta(days=i),) for i in range(10)], "time timestamp")
    got = [r.split for r in timeops.split_samples(t, "2000-01-05", "2000-01-08").orderBy("time").collect()]
    assert got == ["train"] * 3 + [None, "val", "val", None, "test", "test", "test"]
    whole = [r.split for r in timeops.split_samples(t, "2000-01-05", "2000-01-08", gap_days=0).orderBy("time").collect()]
    assert whole == ["train"] * 4 + ["val"] * 3 + ["test"] * 3


def test_windows_clip_to_the_end():
    w = timeops.period_windows("1980-01-01", "2050-06-30", "2014-12-31")
    assert [x[0] for x in w] == ["hist", "future_2015_2029", "future_2030_2044", "future_2045_2059"] and w[-1][2] == "2050-06-30"


def test_unique_match_contract(frame):
    manifest = frame([("a", "p1"), ("b", "p2"), ("b", "p3")], "key string, path string")
    catalog.require_unique(manifest, frame([("a",)], "key string"), "key")
    with pytest.raises(FileNotFoundError):
        catalog.require_unique(manifest, frame([("c",)], "key string"), "key")
    with pytest.raises(FileExistsError, match="found 2"):
        catalog.require_unique(manifest, frame([("b",)], "key string"), "key")


def field(frame, *rows):
    return frame([("s", "tas", sc, "r1", DAY.fromisoformat(t), 0, 0, v) for sc, t, v in rows], "source string, variable string, scenario string, member string, time timestamp, iy int, ix int, value double")


def test_catalog_errors_pruning_and_routing(spark, frame, tmp_path):
    root = str(tmp_path / "cat")
    catalog.write_field(field(frame, ("historical", "2014-12-31", 1.0), ("ssp585", "2014-12-31", 9.0), ("ssp585", "2015-01-01", 2.0), ("historical", "1990-05-05", 3.0)), root)
    cat = catalog.open_catalog(spark, root)
    with pytest.raises(KeyError):
        catalog.require_source(cat, "zz", "tas")
    with pytest.raises(FileNotFoundError):
        catalog.require_source(cat, "s", "tas", "2050-01-01", "2050-12-31")
    rows = catalog.scan_routed(cat, "s", "tas", "ssp585", "2014-12-31", "2015-01-01")
    assert sorted(r.value for r in rows.collect()) == [1.0, 2.0]
    plan = catalog.scan(cat, "s", "tas", "2014-01-01", "2014-12-31", ["historical"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:400]


def test_prediction_window_keeps_first_chunk(frame):
    d = dt.date
    rows = [(d(2000, 1, 1), d(2000, 1, 3), DAY(2000, 1, 3), 0, 0, 1.0), (d(2000, 1, 3), d(2000, 1, 5), DAY(2000, 1, 3), 0, 0, 2.0), (d(2000, 1, 3), d(2000, 1, 5), DAY(2000, 1, 4), 0, 0, 3.0)]
    chunks = frame(rows, "chunk_start date, chunk_end date, time timestamp, iy int, ix int, value double")
    assert sorted(r.value for r in catalog.prediction_window(chunks, "2000-01-02", "2000-01-05").collect()) == [1.0, 3.0]
    assert catalog.prediction_window(chunks, "2000-01-02", "2000-01-05", False).count() == 3


def test_covering_dataset(frame):
    c = frame([("a", 1, DAY(2000, 1, 1)), ("b", 2, DAY(2000, 1, 1)), ("b", 2, DAY(2000, 1, 9))], "dataset string, rank int, time timestamp")
    assert catalog.require_covering(c, "2000-01-01", "2000-01-09") == "b"
    with pytest.raises(FileNotFoundError, match="a, b"):
        catalog.require_covering(c, "2000-01-01", "2001-01-01")


def test_requested_dates(frame):
    f = days(frame, "2000-01-01", "2000-01-02")
    with pytest.raises(KeyError, match="1 requested.*2000-01-05"):
        catalog.require_dates(f, frame([(dt.date(2000, 1, 1),), (dt.date(2000, 1, 5),)], "date date"))


def test_archive_files_roundtrip(spark, frame, tmp_path):
    rows = [(DAY(2000, 1, 1), "x", "elevation", 0, 0, 42.0), (DAY(2000, 1, 1), "x", "psl", 1, 2, 3.5), (DAY(2000, 1, 1), "y", "target", 1, 1, 7.0), (DAY(2000, 1, 2), "x", "psl", 0, 0, 1.0)]
    samples = frame(rows, "time timestamp, role string, channel string, iy int, ix int, value float")
    for r in archives.encode_archives(samples, ["elevation", "psl"], 2, 3).collect():
        (tmp_path / r.path).write_bytes(bytes(r.content))
    with np.load(tmp_path / "sample_20000101.npz") as a:
        assert a["x"].shape == (2, 2, 3) and a["y"].shape == (1, 2, 3) and a["y"][0, 1, 1] == 7.0
    with np.load(tmp_path / "sample_20000102.npz") as a:
        assert a.files == ["x"]
    back = archives.read_archives(spark, str(tmp_path))
    assert back.count() == 12 + 6 + 12
    assert sorted((r.time.day, r.role, r.channel_pos, r.iy, r.ix, r.value) for r in back.where("value is not null").collect()) == [
        (1, "x", 0, 0, 0, 42.0), (1, "x", 1, 1, 2, 3.5), (1, "y", 0, 1, 1, 7.0), (2, "x", 1, 0, 0, 1.0)]


def test_sample_sink_skips_written_times(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    row = lambda d, v: (DAY(2000, 1, d), "x", "c", 0, 0, v)
    ddl = "time timestamp, role string, channel string, iy int, ix int, value float"
    sinks.write_samples(frame([row(1, 1.0)], ddl), path)
    sinks.write_samples(frame([row(1, 9.0), row(2, 2.0)], ddl), path)
    assert sorted((r.token, r.value) for r in sinks.read_samples(spark, path).collect()) == [("20000101", 1.0), ("20000102", 2.0)]


SAMPLE = "time timestamp, role string, channel string, iy int, ix int, value float"


def sample_row(day, value, period=None):
    row = (DAY(2000, 1, day), "x", "c", 0, 0, value)
    return row if period is None else (*row, period)


def test_a_killed_run_is_redone(spark, frame, tmp_path):
    """Rows written but not committed stay unseen, and the next run makes those times again, once."""
    path = str(tmp_path / "s")
    sinks.write_samples(frame([sample_row(1, 1.0)], SAMPLE), path)
    commit, sinks._commit = sinks._commit, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    try:
        with pytest.raises(KeyboardInterrupt):
            sinks.write_samples(frame([sample_row(2, 5.0), sample_row(3, 6.0)], SAMPLE), path)
    finally:
        sinks._commit = commit
    assert [r.token for r in sinks.read_samples(spark, path).collect()] == ["20000101"]
    broken = frame([sample_row(d, 7.0) for d in (2, 3, 4)], SAMPLE).repartition(3).withColumn("value", F.when(F.dayofmonth("time") == 4, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_samples(broken, path)
    last = sinks.write_samples(frame([sample_row(d, 8.0) for d in (1, 2, 3, 4)], SAMPLE), path)
    assert sorted((r.token, r.value) for r in sinks.read_samples(spark, path).collect()) == [("20000101", 1.0), ("20000102", 8.0), ("20000103", 8.0), ("20000104", 8.0)]
    assert len(sinks.sweep_samples(spark, path)) >= 1 and sinks.read_samples(spark, path).count() == 4
    assert {r.attempt for r in sinks.committed(spark, path).where("token > '20000101'").collect()} == {last}


def test_manifest_by_period_and_replacement(spark, frame, tmp_path):
    path, ddl = str(tmp_path / "s"), SAMPLE + ", period string"
    sinks.write_samples(frame([sample_row(1, 1.0, "hist"), sample_row(2, 2.0, "hist")], ddl), path)
    sinks.write_samples(frame([sample_row(1, 9.0, "hist"), sample_row(1, 3.0, "future")], ddl), path)
    got = lambda: sorted((r.period, r.token, r.value) for r in sinks.read_samples(spark, path).collect())
    assert got() == [("future", "20000101", 3.0), ("hist", "20000101", 1.0), ("hist", "20000102", 2.0)]
    sinks.write_samples(frame([sample_row(1, 4.0, "hist")], ddl), path, skip_existing=False)
    assert ("hist", "20000101", 4.0) in got() and len(got()) == 3
    with pytest.raises(FileNotFoundError):
        sinks.read_samples(spark, str(tmp_path / "nothing"))


def archive_rows():
    return [(DAY(2000, 1, d), role, c, iy, ix, float(d * 10 + iy + ix)) for d in range(1, 8) for role, c in (("x", "a"), ("x", "b"), ("y", "t")) for iy in range(2) for ix in range(3) if d < 6 or role == "x"]


def test_archive_source_prunes_by_name(spark, frame, tmp_path):
    folder = str(tmp_path / "a")
    archive_source.write_archives(frame(archive_rows(), SAMPLE), folder, ["a", "b"], 2, 3)
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".npz")
    assert names == [f"sample_2000010{d}.npz" for d in range(1, 8)] and not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".sample")]
    channel = {("x", "a"): 0, ("x", "b"): 1, ("y", "t"): 0}
    want = sorted((t.day, role, channel[role, c], iy, ix, v) for t, role, c, iy, ix, v in archive_rows())
    got = lambda df: sorted((r.time.day, r.role, r.channel_pos, r.iy, r.ix, r.value) for r in df.collect())
    assert got(archive_source.scan_archives(spark, folder)) == want
    (tmp_path / "a" / "sample_20000105.npz").write_bytes(b"no archive")  # not opened by a scan of other days
    (tmp_path / "a" / "notes.txt").write_text("x")
    part = archive_source.scan_archives(spark, folder, "2000-01-02", "2000-01-04")
    assert got(part) == [w for w in want if 2 <= w[0] <= 4]
    reader = archive_source.PrunedArchiveReader({"path": folder, "start": "2000-01-02"})
    list(reader.pushFilters([archive_source.ds.LessThan(("time",), DAY(2000, 1, 4)), archive_source.ds.EqualTo(("role",), "x")]))
    assert [at.day for p in reader.partitions() for _, at in p.value] == [2, 3]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = archive_source.scan_archives(spark, folder).where("time < timestamp '2000-01-05' and time >= timestamp '2000-01-03'")
        assert got(pushed) == [w for w in want if 3 <= w[0] <= 4]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archive_headers(spark, frame, tmp_path):
    folder = str(tmp_path / "a")
    archive_source.write_archives(frame(archive_rows(), SAMPLE), folder, ["a", "b"], 2, 3)
    np.savez(tmp_path / "a" / "sample_20000108.npz", x=np.zeros((2, 2, 3)), y=np.zeros((1, 2, 4), np.float32))
    np.savez(tmp_path / "a" / "sample_20000109.npz", x=np.zeros(5, np.float32))
    table = archive_source.archive_structure(archive_source.archive_headers(spark, folder), "2000-01-06").collect()
    got = {r.date.day: (r.roles, r.channels, r.ny, r.nx, r.status) for r in table}
    assert got[1] == ("x,y", 2, 2, 3, "ok") and got[6] == ("x", 2, 2, 3, "fail") and got[7] == ("x", 2, 2, 3, "ok")
    assert got[8][-1] == got[9][-1] == "fail"


def test_quotas_fill_uneven_days(spark, frame):
    sizes = [3, 0, 10, 7, 7, 1, 12]
    days = frame([(DAY(2000, 1, d + 1), n) for d, n in enumerate(sizes)], "time timestamp, rows int")
    for total in (0, 1, 6, 13, 30, 39, 40, 100):
        got = [r.quota for r in value.day_quotas(days, total).orderBy("time").collect()]
        assert sum(got) == min(total, sum(sizes)) and all(q <= n for q, n in zip(got, sizes))
        level = max(got)
        assert all(q == n or q >= level - 1 for q, n in zip(got, sizes))


def test_total_cap_is_met_exactly(frame):
    rows = [(DAY(2000, 1, d), 0, i, float(i), float(-i)) for d, n in ((1, 3), (2, 40), (3, 25)) for i in range(n)]
    pairs = frame(rows, "time timestamp, iy int, ix int, obs double, pred double")
    for total, want in ((100, [3, 20, 20]), (30, [3, 14, 13]), (5, [2, 2, 1])):
        kept = value.seeded_sample(pairs, 20, total=total).collect()
        assert sorted(sum(r.time.day == d for r in kept) for d in (1, 2, 3)) == sorted(want)
        assert all(r.obs == -r.pred for r in kept) and len({(r.time, r.ix) for r in kept}) == len(kept)


def test_frozen_statistics(spark, frame, tmp_path):
    path = str(tmp_path / "st")
    with pytest.raises(FileNotFoundError):
        sinks.frozen_statistics(spark, "r", path)
    stats = frame([("c", 1.0, 2.0, 0.0, 3.0)], "channel string, mean double, std double, min double, max double")
    sinks.freeze_statistics(stats, "r", path)
    assert sinks.frozen_statistics(spark, "r", path).first().std == 2.0
    assert sinks.statistics_map(stats).first().statistics["c"]["max"] == 3.0


def test_quality_messages(frame):
    f = frame([("s", "tas", "f.nc", DAY(2000, 1, 1))], "source string, variable string, file string, time timestamp")
    with pytest.raises(ValueError, match="source=s, variable=tas, file=f.nc: 1 of 7305"):
        quality.require_time_length(f, 7305)
    with pytest.raises(ValueError, match="nothing"):
        require_rows(f.where("false"), "nothing")
    e = frame([("a",), ("b",)], "k string")
    r = inventory_diff(e, frame([("b",), ("c",)], "k string"), "k").first()
    assert (r.missing_head, r.extra_head, r.status) == ("a", "c", "fail")
    assert inventory_diff(e, frame([("a",), ("b",), ("c",)], "k string"), "k", allow_extra=True).first().status == "ok"


def test_readers_by_kind_and_their_errors(spark, frame, tmp_path):
    ddl = "source string, variable string, scenario string, member string, time timestamp, iy int, ix int, value double"
    rows = [("obs", "tas", "historical", "r1", DAY(2000, 1, 1, h), 0, x, float(x + h)) for h in (0, 12) for x in range(3)]
    rows += [("rcm", "pr", s, "r1", DAY(y, 1, 1), 0, x, -1.0 if x == 0 else 1 / 86400) for s, y in (("historical", 2014), ("ssp585", 2015)) for x in range(3)]
    catalog.write_field(frame(rows, ddl), str(tmp_path / "c"))
    cat = catalog.open_catalog(spark, str(tmp_path / "c"))
    grid = frame([(0, x, 350.0 + x * 8, 45.0) for x in range(3)], "iy int, ix int, longitude double, latitude double")
    obs = readers.Source("obs", "observation", "eobs", "eobs", "eobs")
    mask = frame([(0, 0, 1.0), (0, 1, 0.0)], "iy int, ix int, mask_value double")
    got = readers.read(cat, obs, grid, "tas", "2000-01-01", "2000-01-01", (-11.0, 0.0, 40.0, 50.0), mask=mask).collect()
    assert sorted((r.ix, r.lon, r.value) for r in got) == [(0, -10.0, None), (1, -2.0, pytest.approx(7.0 + 273.15))]
    with pytest.raises(ValueError, match="no mask"):
        readers.read(cat, obs, grid, "tas", "2000-01-01", "2000-01-01", None)
    rcm = readers.Source("rcm", "model", "rcm", "rcm")
    axes = frame([(0, x, 12.5 * x, 1.0) for x in range(3)], "iy int, ix int, x double, y double")
    got = readers.read(cat, rcm, axes, "pr", "2014-01-01", "2015-12-31").collect()
    assert len(got) == 6 and {(r.ix, r.x, r.value) for r in got} == {(0, 0.0, 0.0), (1, 12500.0, 1.0), (2, 25000.0, 1.0)}
    with pytest.raises(ValueError, match="projected"):
        readers.read(cat, rcm, grid, "pr", "2014-01-01", "2014-12-31")
    with pytest.raises(KeyError, match="unknown source"):
        readers.read(cat, readers.Source("none", "reanalysis", "latlon", "era5"), grid, "tas", "2000-01-01", "2000-01-02", (0, 1, 0, 1))
    with pytest.raises(FileNotFoundError):
        readers.read(cat, rcm, axes, "tas", "2014-01-01", "2014-12-31")
    with pytest.raises(KeyError, match="kind"):
        readers.read(cat, readers.Source("obs", "satellite", "latlon", "x"), grid, "tas", "2000-01-01", "2000-01-02")
    assert (readers.family_of(axes), readers.family_of(grid)) == ("rcm", "latlon")
