"""Spark against DuckDB on the same parquet tables, order and type-width aside."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, run, sql: str | None, sf_dir: str) -> dict:
    start = time.time()
    df = run(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = {"query": name, "rows": len(left), "seconds": round(time.time() - start, 2), "ok": None, "columns": df.columns}
    if sql is None:
        return out
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    start = time.time()
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    right = _rows(columns, cur.fetchall())
    out["sql_seconds"] = round(time.time() - start, 2)
    out["ok"] = sorted(columns) == sorted(df.columns) and left == right
    if not out["ok"]:
        missing = [r for r in right if r not in set(left)][:3] if len(right) < 200_000 else []
        extra = [r for r in left if r not in set(right)][:3] if len(left) < 200_000 else []
        out["diff"] = {"columns": (sorted(df.columns), sorted(columns)), "counts": (len(left), len(right)), "missing": missing, "extra": extra}
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry
    from impactlens.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(**{"spark.ui.showConsoleProgress": "false"})
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if wanted and name not in wanted and not any(run.__module__.endswith(w) for w in wanted):
            continue
        try:
            print(compare(spark, name, run, oracles.get(name), f"/root/testdata/sf{sf}"), flush=True)
        except Exception as exc:  # noqa: BLE001
            print({"query": name, "error": f"{type(exc).__name__}: {str(exc)[:700]}"}, flush=True)
