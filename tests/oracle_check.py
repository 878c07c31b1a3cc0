"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tolist"):
        value = value.tolist()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


SAME = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, db, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result, empty when they agree."""
    relation = db.sql(sql)
    want_columns = list(relation.columns)
    want_types = {c: SAME.get(str(t), str(t)) for c, t in zip(want_columns, relation.types)}
    problems = []
    if sorted(df.columns) != sorted(want_columns):
        return [f"columns {sorted(df.columns)} / {sorted(want_columns)}"]
    got_types = dict(df.dtypes)
    for c in want_columns:
        if got_types[c] != want_types[c]:
            problems.append(f"type of {c}: {got_types[c]} / {want_types[c]}")
    want = _rows(want_columns, relation.fetchall())
    got = _rows(df.columns, df.collect())
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry_points
    from stayscope.session import local_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries), set(oracles) - set(queries)
    failed = 0
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                problems = compare(df, db, oracles[name])
                note = "ok" if not problems else "; ".join(problems)
            else:
                n = df.count()
                problems, note = ([] if n else ["empty"]), f"rows only: {n}"
        except Exception as error:  # report and go on with the others
            problems, note = [str(error)], f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'pass'} {name} {time.time() - start:.1f}s {note[:900]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
