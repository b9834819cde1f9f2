"""Hard negatives: SQL, a plain loop over odd vectors, packed keys, and exact scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score long, windows string, block int"


def brute(rows, rule=None):
    rule = rule or hn.Rule()
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, anchor in enumerate(whole):
        if anchor[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1]) for k, r in enumerate(whole) if k != a]
        for ps, p, _ in sorted(s for s in scored if s[2] == anchor[1])[: rule.positives]:
            fits = sorted(s for s in scored if s[2] != anchor[1] and rule.low * -ps <= 100 * -s[0] <= rule.high * -ps)
            out += [(anchor[0], p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[: rule.negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, 9, "x", 3) for i, v, label in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(frame, label=label, anchor=F.col("vec_id") % 100 == 0, **options).collect())


def test_sql(compare, small):
    assert compare("op13_hard_negatives", small) == ""


def vectors(n, seed=0, width=6, hot=False):
    rng = np.random.default_rng(seed)
    return [(int(i) * 10, [float(np.float32(x)) for x in rng.normal(0.2, 0.5, width)], 3 if hot and i % 3 else int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("hot", [False, True])
def test_as_a_plain_loop(spark, hot):
    rows = vectors(150, hot=hot)
    got = mined(spark, rows)
    assert got and got == brute(rows)


def test_small_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "BATCH", 2)
    rows = vectors(120, seed=4)
    rule = hn.Rule(positives=3, negatives=2, low=-20, high=95)
    assert mined(spark, rows, rule=rule) == brute(rows, rule)


def test_odd_rows(spark):
    """Nulls, values that aren't finite, empty and short vectors, ties, zero scores, repeated rows, a null identifier."""
    rows = [
        (0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2),
        (3, None, 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 2), (6, [None, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (200, [0.0, 0.0], 4), (9, [0.3, 0.3], 4), (10, [1.0, 2.0], 5), (300, [-1.0, 0.0], 6), (11, [1.0, 0.0], 6), (400, [], 8), (12, [0.7], 8),
        (13, [0.6], 1), (500, [0.4, 0.1], 99),
    ]
    got = mined(spark, rows)
    assert got and got == brute(rows)
    assert any(r[4] == 0 and r[5] == 0 for r in got)  # a positive and its negatives may all score zero


def test_many_ties(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(0, 400, 4)] + [(i, [0.25, 0.25], 3) for i in range(1, 200, 4)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty).count() == 0


def test_packed_keys_sort_as_their_parts():
    parts = [(r, s, n, i) for r in (0, 5) for s in (-(2**62), -1, 0, 7, 2**62) for n in (0, 1) for i in (-9, 0, 2**40)]
    keys = {hn.packed(*p): p for p in parts}
    assert [keys[k] for k in sorted(keys)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert all(hn.unpacked(k) == p for k, p in keys.items())
    assert len({hn._shard(hn.packed(5, s, n, i), 7) for s in (1, 2) for n in (0, 1) for i in (1, 2)}) == 1


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, 1], [5, 2]])
    assert hn._scores(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3, 5 * (2**40 + 1) + 6]]
    with pytest.raises(OverflowError):
        hn._scores(np.array([[2**40]]), np.array([[2**40]]))


def test_wrong_parameters():
    for options in ({"positives": 0}, {"negatives": 0}, {"low": 5, "high": 4}):
        with pytest.raises(ValueError):
            hn.Rule(**options)
