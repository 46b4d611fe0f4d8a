"""Run registered queries against their oracle SQL: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def first_row(con, text: str, seconds: float = 20) -> str:
    """'' if a first row of the text comes in time: a limit on top must not change how it is run."""
    timer = threading.Timer(seconds, con.interrupt)
    timer.start()
    try:
        con.execute(f"SELECT * FROM ({text}) LIMIT 1").fetchall()
    except Exception as error:  # noqa: BLE001 - report and go on
        return f"with LIMIT 1: {type(error).__name__}: {str(error)[:200]}"
    finally:
        timer.cancel()
    return ""


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def compare(spark, con, name, run, text, sf_dir) -> str:
    """'' when equal, else what differs."""
    df = run(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if text is None:
        return ""
    got = con.execute(text)
    columns = [c[0] for c in got.description]
    want = got.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not mine:
        return "no rows" if want else ""
    a, b = normal(mine, df.columns), normal(want, columns)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows != {len(b)}; {extra}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{sorted(columns)}\n   spark {x}\n   duckdb {y}"
    return ""


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from spanlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    texts, bad = oracle_sql(), 0
    for name, run in queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, name, run, texts.get(name), sf_dir) or (first_row(con, texts[name]) if texts.get(name) else "")
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
