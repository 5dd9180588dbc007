"""Runs registered queries beside their oracle SQL and reports differences (also used by the test-suite)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings files source_texts nodes edges "
    "call_sites ranks node_vectors third_party abuse_labels eval_items mix_targets"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{root}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, fn, sql: str, root: str) -> str | None:
    df = fn(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(root).execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} against {sorted(want_cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return None


def main(names: list[str], root: str) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from quillgraph.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = e.queries(), e.oracle_sql(), 0
    for name in names or list(queries):
        began = time.time()
        try:
            if name in oracles:
                why = compare(spark, queries[name], oracles[name], root)
            else:
                why = f"no oracle, {len(queries[name](spark, root).collect())} rows"
        except Exception as ex:  # noqa: BLE001
            why = f"{type(ex).__name__}: {str(ex)[:600]}"
        ok = why is None or why.startswith("no oracle")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {why or ''}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    root = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    sys.exit(main([a for a in args if not a.startswith("/")], root))
