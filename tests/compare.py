"""Compare registered queries with their SQL on the same tables.

    python -m tests.compare [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None:
        return "∅"
    if isinstance(x, bool):
        return repr(x)
    if isinstance(x, Decimal):
        return f"decimal:{x}"
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else repr(x)
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, sql: str, con) -> list[str]:
    got = spark_df.collect()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    gn, gr = rows_of(spark_df.columns, got)
    wn, wr = rows_of(names, want)
    problems = []
    if gn != wn:
        problems.append(f"columns {gn} != {wn}")
    if len(gr) != len(wr):
        problems.append(f"rows {len(gr)} != {len(wr)}")
    if not problems and gr != wr:
        only_g, only_w = sorted(set(gr) - set(wr)), sorted(set(wr) - set(gr))
        problems.append(f"{len(only_g)}/{len(only_w)} rows differ, e.g. {only_g[:2]} vs {only_w[:2]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from flowgauge.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, oracles[name], con)
                note = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
                note = f"rows={n}"
        except Exception as e:  # noqa: BLE001
            problems = [str(e)]
            note = "ERROR " + type(e).__name__ + " " + str(e)[:600]
        bad += bool(problems)
        print(f"{name:32s} {time.perf_counter() - start:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main())
