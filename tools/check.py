"""Compare every query with its stated SQL result: python tools/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from presslake.session import local_session  # noqa: E402
from presslake.workloads import QUERIES, SQL  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(spark, db, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in SQL:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    result = db.execute(SQL[name])
    want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} / {want_columns}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} / {len(want)} rows\n   got  {str(only_got)[:900]}\n   want {str(only_want)[:900]}"
    return True, f"{len(got)} rows, {took:.1f}s"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, db = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, db, sf_dir, name)
        except Exception as error:  # one broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
