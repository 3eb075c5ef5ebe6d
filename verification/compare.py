"""Run registered queries against their SQL: ``python -m verification.compare [names]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from verification import oracle, registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("timelens")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="timelens-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(rows: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name; nulls and numbers made alike."""

    def text(value) -> str:
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "~null"
        if isinstance(value, float):  # whole numbers become floats where a column has nulls
            return str(int(value)) if value.is_integer() else repr(round(value, 6))
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(value)

    ordered = rows[sorted(rows.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in ordered.itertuples(index=False))


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    """Empty text if both sides agree, else what differs."""
    found = registry.queries()[name](spark, sf_dir).toPandas()
    wanted = con.execute(oracle.oracle_sql()[name]).df()
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} and {sorted(wanted.columns)}"
    left, right = canonical(found), canonical(wanted)
    if left == right:
        return ""
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return f"{len(left)} and {len(right)} rows; spark {only_left} sql {only_right}"


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), sql_connection(sf_dir)
    failed = 0
    for name in names or list(registry.queries()):
        began = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
