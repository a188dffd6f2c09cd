"""Compare registered queries with their SQL: `python -m workload.check [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    return str(v) if type(v).__name__ == "Decimal" else v


def _rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return _rows(names, cur.fetchall())


def main() -> int:
    from indexloom.session import local_session
    from workload import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(int(os.environ.get("BENCH_CPUS", "8"))), connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            names, rows = spark_rows(QUERIES[name](spark, sf_dir))
        except Exception as error:  # report and go on to the next query
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(rows)} rows, {took:.1f}s", flush=True)
            continue
        try:
            other_names, other = sql_rows(con, ORACLES[name])
        except Exception as error:
            print(f"FAIL {name}: SQL {str(error)[:600]}", flush=True)
            bad += 1
            continue
        if names == other_names and rows == other:
            print(f"ok   {name}: {len(rows)} rows, {took:.1f}s", flush=True)
            continue
        bad += 1
        ours, theirs = set(map(repr, rows)), set(map(repr, other))
        print(f"FAIL {name}: {len(rows)} / {len(other)} rows, columns {names} / {other_names}")
        print("   only Spark:", [r[:300] for r in sorted(ours - theirs)[:3]])
        print("   only SQL:  ", [r[:300] for r in sorted(theirs - ours)[:3]], flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
