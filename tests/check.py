"""Compare registered queries with their SQL twins: python -m tests.check [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "is_finite"):
        return float(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def differ(df, con, sql) -> str | None:
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows on either side"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {sorted(cols)}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None


def main(argv):
    from arcline.operators import ordered
    from arcline.session import local_session
    import __spark_entry__ as e

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    if os.environ.get("BLOCK"):
        ordered.BLOCK = int(os.environ["BLOCK"])
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in oracles:
                msg = differ(df, con, oracles[n])
            else:
                k = len(df.collect())
                msg = None if k else "no rows"
                n = f"{n} (rows only: {k})"
        except Exception as ex:  # noqa: BLE001
            msg = f"{type(ex).__name__}: {str(ex)[:1500]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {time.time() - t0:6.2f}s {n}" + (f"\n   {msg}" if msg else ""), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
