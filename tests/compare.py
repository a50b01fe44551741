"""Run registered queries against their SQL in DuckDB: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("earthframe-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                            if not isinstance(v, (list, dict)) else (False, "", str(v))
                                            for v in r))


def difference(spark, con, build, sql, sf_dir) -> str | None:
    """Why the two results differ, or None. Columns by name, rows as a multiset."""
    df = build(spark, sf_dir)
    mine_cols = sorted(df.columns)
    mine = _sorted(tuple(_plain(r[c]) for c in mine_cols) for r in df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    theirs = _sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    if mine_cols != sorted(cols):
        return f"columns {mine_cols} vs {sorted(cols)}"
    if mine != theirs:
        from collections import Counter

        left, right = Counter(map(repr, mine)), Counter(map(repr, theirs))
        only, other = list((left - right).elements()), list((right - left).elements())
        if only or other:
            return (f"{len(mine)} rows vs {len(theirs)}, {len(only)}/{len(other)} unmatched; "
                    f"{mine_cols}: {sorted(only)[:2]} vs {sorted(other)[:2]}")
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, build, oracles[name], sf_dir)
            else:
                problem = None if build(spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {time.time() - start:6.2f}s {name}{'' if name in oracles else ' (rows)'}"
              f"{': ' + problem if problem else ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
