"""Holds Spark's rows of registered queries against DuckDB's: python -m tests.check_oracle [dir] [names]."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, float):
        return "None" if v != v else repr(round(v, 8) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    wanted_names, wanted = rows_of([d[0] for d in rel.description], rel.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != wanted:
        only, lack = set(got) - set(wanted), set(wanted) - set(got)
        return f"{len(got)} and {len(wanted)} rows; {len(only)} only here, {len(lack)} only there: {sorted(only)[:3]} {sorted(lack)[:3]}"
    return ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), tables(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = differences(spark, con, queries[name], sql[name], sf_dir) if name in sql else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception:
            said = "FAILED " + traceback.format_exc()[-700:]
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
