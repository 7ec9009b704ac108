"""Run check queries against DuckDB: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import ORACLES, QUERIES
from pricelake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir: str, name: str, inspect=None) -> tuple[bool, str]:
    """Run one query and compare it; ``inspect`` may look at the DataFrame before it runs."""
    begin = time.time()
    df = QUERIES[name](spark, sf_dir)
    if inspect is not None:
        inspect(df)
    got = rows_of(df.columns, df.collect())
    took = f"{time.time() - begin:.1f}s"
    if name not in ORACLES:
        return True, f"rows={len(got)} (no SQL) {took}"
    res = con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, res.fetchall())
    if got == want:
        return True, f"rows={len(got)} {took}"
    a, b = set(got), set(want)
    return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    spark, con, bad = build_session(), connect(sf_dir), 0
    for name in names:
        try:
            ok, note = check(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next one
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
