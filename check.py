"""Run registered queries beside their SQL and report differences: ``python check.py [-s SF] [name ...]``."""

from __future__ import annotations

import argparse
import time

import duckdb
import pandas as pd

from gridloom.plans import REGISTRY
from gridloom.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last", key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            bad.append(f"{c}: {(~same).sum()} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
        if a[c].dtype != b[c].dtype and not (a[c].dtype.kind in "OUTfi" and b[c].dtype.kind in "OUTfi"):
            bad.append(f"{c}: {a[c].dtype} vs {b[c].dtype}")
    return "; ".join(bad)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf_dir}/{t}.parquet'")
    wrong = 0
    for name, q in REGISTRY.items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            got = normal(q.run(spark, args.sf_dir).toPandas())
            t1 = time.time()
            if q.sql is None:
                verdict = f"rows only ({len(got)})" if len(got) else "EMPTY"
            else:
                diff = differences(got, normal(con.execute(q.sql).df()))
                verdict = f"ok ({len(got)})" if not diff and len(got) else (diff or "EMPTY")
        except Exception as e:
            t1 = time.time()
            verdict = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        wrong += not verdict.startswith(("ok", "rows only"))
        print(f"{name:38s} {t1 - t0:6.2f}s  {verdict}", flush=True)
    print(f"{wrong} wrong")
    return wrong


if __name__ == "__main__":
    raise SystemExit(main())
