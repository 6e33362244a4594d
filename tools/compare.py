"""Run registered queries on Spark and their oracles on DuckDB and compare the rows.

usage: python tools/compare.py [--sf DIR] [name-substring ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(canon(item)) for item in value) + "]"
    return "∅" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return sorted(tuple(canon(row[index]) for index in order) for row in rows)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    return [item[0] for item in cursor.description], cursor.fetchall()


def check(spark, name, run, sql, sf_dir):
    """Return (ok, message) for one query."""
    frame = run(spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    if sql is None:
        return True, f"{len(rows)} rows (no oracle)"
    columns, expected = duck_rows(sql, sf_dir)
    if sorted(frame.columns) != sorted(columns):
        return False, f"columns differ: {sorted(frame.columns)} vs {sorted(columns)}"
    left, right = rows_of(frame.columns, rows), rows_of(columns, expected)
    if left == right:
        return True, f"{len(rows)} rows"
    only_left = [row for row in left if row not in set(right)][:3]
    only_right = [row for row in right if row not in set(left)][:3]
    return False, f"{len(left)} vs {len(right)} rows\n   spark {only_left}\n   duck  {only_right}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--module", default="")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from digestmill.plans.queries import ORACLES, QUERIES
    from digestmill.session import local_session

    spark = local_session()
    failed = []
    for name, run in QUERIES.items():
        if args.module and not run.__wrapped_module__.endswith(args.module):
            continue
        if args.names and not any(part in name for part in args.names):
            continue
        start = time.time()
        try:
            ok, message = check(spark, name, run, ORACLES.get(name), args.sf)
        except Exception as exc:  # noqa: BLE001
            ok, message = False, "".join(traceback.format_exception_only(exc))[:1500]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message[:3000]}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
