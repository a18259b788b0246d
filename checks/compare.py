"""Run registered queries against their SQL: python -m checks.compare [folder] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    started = time.monotonic()
    df = query(spark, folder)
    mine = df.collect()
    took = time.monotonic() - started
    if sql is None:
        return f"rows {len(mine):>7} {took:6.1f}s  {name} (no SQL)"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {name}: only Spark {set(df.columns) - set(names)}, only SQL {set(names) - set(df.columns)}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        return f"ok   {len(a):>7} {took:6.1f}s  {name}"
    out = [f"DIFFER {name}: {len(a)} rows against {len(b)}; columns {sorted(names)}"]
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    out += [f"   spark {r}" for r in only_a] + [f"   sql   {r}" for r in only_b]
    return "\n".join(out)


def main() -> int:
    from checks import ORACLES, QUERIES
    from tidegauge.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("checks", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        try:
            line = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as err:  # noqa: BLE001 - every query gets its line
            line = f"ERROR {name}: {str(err)[:700]}"
        bad += not line.startswith(("ok", "rows"))
        print(line, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
