"""Run queries next to their reference SQL: ``python -m cellgauge.catalog.check SF_DIR [PREFIX ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from cellgauge.catalog.registry import oracle_sql, queries
from cellgauge.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v != v or v is pd.NA else repr(v.item() if hasattr(v, "item") else v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """A description of the first difference, or None."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = normal(spark_df), normal(sql_df)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} of {len(a)} rows differ\n{a[bad].head(4).to_string()}\n{b[bad].head(4).to_string()}"
    if len(a) == 0:
        return "no rows"
    return None


def main(sf: str, prefixes: list[str]) -> int:
    spark = local_session(8)
    con = connect(sf)
    sqls, failed, slow = oracle_sql(), [], []
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            if name in sqls:
                cur = con.execute(sqls[name])
                error = compare(got, cur.df())
            else:
                error = None if len(got) else "no rows"
        except Exception as e:  # noqa: BLE001
            took = time.time() - start
            error = f"{type(e).__name__}: {str(e)[:1500]}" if len(str(e)) > 5 else traceback.format_exc()[-1500:]
        slow.append((took, name))
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if error else 'ok  '} {name} [{kind}] {took:.1f}s {len(got) if not error else ''}", flush=True)
        if error:
            failed.append(name)
            print("   ", error.replace("\n", "\n    "), flush=True)
    print(f"{len(slow) - len(failed)} ok, {len(failed)} failed: {failed}; slowest {sorted(slow)[::-1][:8]}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
