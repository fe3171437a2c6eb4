"""Compares registered queries with their SQL on DuckDB: python -m tests.oracle sf0.01 [keys...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)  # a column of whole numbers with nulls comes as floats from either side
    return str(v)


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    data = [pdf[c].tolist() for c in cols]
    return sorted(tuple(norm(x) for x in r) for r in zip(*data))


def kind(dtype) -> str:
    k = dtype.kind
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(k, "obj")


def compare(spark, con, key, fn, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"rows-only n={len(got)} spark={t1 - t0:.1f}s"
    want = con.execute(sql).df()
    t2 = time.time()
    info = f"n={len(got)}/{len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, info + f" columns {sorted(got.columns)} vs {sorted(want.columns)}"
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if kind(got[c].dtype) != kind(want[c].dtype)]
    a, b = rows_of(got), rows_of(want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, info + f" MISMATCH {sorted(got.columns)} only spark {sorted(sa - sb)[:3]} ({len(sa - sb)}) only sql {sorted(sb - sa)[:3]} ({len(sb - sa)})"
    return True, info + (f" type-diff {types}" if types else "") + (" EMPTY" if not len(got) else "")


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from seqloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    con = duck(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(q)
    bad = []
    for k in keys:
        try:
            ok, msg = compare(spark, con, k, q[k], o.get(k), sf_dir)
        except Exception as e:  # report and go on with the next key
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print("ok  " if ok else "FAIL", k, msg, flush=True)
        if not ok:
            bad.append(k)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; failed: {bad}")


if __name__ == "__main__":
    main()
