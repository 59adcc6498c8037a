"""Run queries and their SQL side by side: python tests/compare.py SF NAME..."""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        f = float(value)
        # As text, for -0.0 equals 0.0 as a number and the driver tells them apart.
        return repr(f) if math.isnan(f) or math.isinf(f) else repr(float(f"{f:.12g}"))
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(root).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def difference(spark, fn, sql: str, root: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = fn(spark, root)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck(root)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return ""
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    a, b = [r for r in ours if repr(r) not in right], [r for r in theirs if repr(r) not in left]
    return f"{len(ours)} and {len(theirs)} rows; only here {a[:2]}; only in SQL {b[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from stepforge.session import local_session

    spark = local_session(cores="8")
    root = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(e.queries())
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in e.oracle_sql():
                said = difference(spark, e.queries()[name], e.oracle_sql()[name], root)
            else:
                df = e.queries()[name](spark, root)
                said = "" if df.count() >= 0 else "?"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(said)
        print(f"{'BAD' if said else 'ok '} {name} {time.time() - began:.1f}s {said}", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
