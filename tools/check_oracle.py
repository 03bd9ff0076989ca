"""Run registered queries in Spark and their SQL twins in DuckDB; compare like the driver.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def normalise(df):
    import pandas as pd
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else
                          (format(v, ".10g") if isinstance(v, float) else str(v)))
    rows = sorted(tuple("\x00" if v is None else v for v in r) for r in df.itertuples(index=False))
    return rows


def compare(spark, con, name, q, sf_dir):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    s = sdf.toPandas()
    ts = time.time() - t0
    if not q.sql:
        return dict(name=name, ok=None, rows=len(s), secs=ts, note="no sql twin")
    con.execute(f"CREATE OR REPLACE VIEW twin AS {q.sql}")        # as the driver does: a view needs fixed columns
    d = con.execute("SELECT * FROM twin").df()
    info = dict(name=name, rows=len(s), oracle_rows=len(d), secs=round(ts, 2))
    if sorted(s.columns) != sorted(d.columns):
        return dict(info, ok=False, note=f"columns {sorted(s.columns)} vs {sorted(d.columns)}")
    if len(s) != len(d):
        return dict(info, ok=False, note="row count")
    a, b = normalise(s), normalise(d)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return dict(info, ok=False, note=f"values {diff}")
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = dict(zip(d.columns, [str(t) for t in d.dtypes]))
    return dict(info, ok=True, types=[(c, stypes[c], dtypes[c]) for c in sorted(stypes)])


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    from trajectra.plans import load_all
    from trajectra.session import build_session
    spark = build_session(f"local[{os.environ.get('CHECK_CPUS', '8')}]", 8)
    con = duck(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, note=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(("OK  " if r.get("ok") else "--  " if r.get("ok") is None else "BAD ") + str(r), flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
