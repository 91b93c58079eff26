"""Time each oracle SQL in DuckDB (single process, all cores) on one scale factor.

with pandas and an embedded DuckDB, and publishes no timings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from aeris.plans.catalog import oracle_sql  # noqa: E402
from aeris.sources.tables import TABLES  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = {}
    for name, sql in oracle_sql().items():
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        out[name] = round(best, 3)
    print(json.dumps({"engine": "duckdb " + duckdb.__version__, "sf_dir": sf,
                      "total": round(sum(out.values()), 3), "queries": out}))


if __name__ == "__main__":
    main()
