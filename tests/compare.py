"""Run the registered queries beside their SQL oracles: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def make_session(cpus: int | str = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basecov")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows in any order, else what differs."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    a, b = canonical(got), canonical(expected)
    for name in a.columns:
        if str(a[name].dtype) != str(b[name].dtype) and not (a[name].dtype == object or b[name].dtype == object):
            return f"{name}: type {a[name].dtype} != {b[name].dtype}"
        unequal = (a[name] != b[name]) & ~(a[name].isna() & b[name].isna())
        if unequal.any():
            return f"{name}: {int(unequal.sum())} values, e.g.\n{a[unequal].head(3)}\n{b[unequal].head(3)}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as registry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sys.argv[1])
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = registry.oracle_sql(), []
    for name, build in registry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            got = build(spark, sf_dir).toPandas()
            took = time.time() - began
            began = time.time()
            expected = con.execute(oracles[name]).df()
            problem = difference(got, expected)
            print(f"{name}: {problem or 'ok'} rows={len(got)} spark={took:.2f}s sql={time.time() - began:.2f}s", flush=True)
        except Exception as error:
            problem = str(error)[:1500]
            print(f"{name}: ERROR {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
