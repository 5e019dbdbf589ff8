"""Run queries on Spark and their SQL on DuckDB and compare the rows.

python -m checks.compare [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
import traceback

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return True, f"{len(got[1])} rows, no SQL"
    cursor = con.execute(ORACLE[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} <> {want[0]}"
    if got[1] == want[1]:
        return True, f"{len(got[1])} rows"
    only_got = [row for row in got[1] if row not in set(want[1])][:3]
    only_want = [row for row in want[1] if row not in set(got[1])][:3]
    return False, f"{len(got[1])} rows <> {len(want[1])}\n    spark {only_got}\n    sql   {only_want}"


def main(argv: list[str]) -> int:
    from tests.session import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = make_session(), connect(sf_dir), 0
    for name in QUERIES:
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as exc:  # a failing query must not hide the others
            ok, note = False, "".join(traceback.format_exception_only(exc)).strip()[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name:32s} {time.time() - begin:6.2f}s  {note}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
