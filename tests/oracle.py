"""Run registered queries against their SQL counterparts and compare.

    python tests/oracle.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as contract
from threatloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("THREATLOOM_TESTDATA", "/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = contract.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return bool(got), f"{len(got)} rows (no SQL)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"{len(got)} vs {len(want)} rows; {sorted(names)}; first differences {str(diff)[:1500]}"
    if not got:
        return False, "empty"
    constant = [n for i, n in enumerate(sorted(names)) if len({r[i] for r in got}) == 1]
    return True, f"{len(got)} rows" + (f", constant {constant}" if constant and len(got) > 1 else "")


def main(argv: list[str]) -> int:
    sf = "sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"{DATA}/{sf}"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in argv or contract.queries():
        start = time.time()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
