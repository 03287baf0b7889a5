"""Run registered queries in Spark and their twins in DuckDB and compare the rows.

    python -m checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from millrace.session import build_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return con


def _cell(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of rows, and what differs."""
    start = time.time()
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    print(f"   spark {time.time() - start:.1f} s", end=" ", flush=True)
    relation = con.sql(sql)
    columns = relation.columns
    theirs = _rows(columns, relation.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return len(ours), [f"columns {sorted(spark_df.columns)} / {sorted(columns)}"]
    if ours == theirs:
        return len(ours), []
    missing, extra = sorted(set(theirs) - set(ours)), sorted(set(ours) - set(theirs))
    return len(ours), [f"rows {len(ours)} / {len(theirs)}", f"only spark: {extra[:3]}", f"only sql: {missing[:3]}"]


def main(root: str, names: list[str]) -> int:
    spark: SparkSession = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLES:
                count, problems = differences(QUERIES[name](spark, root), con, ORACLES[name])
            else:
                count, problems = QUERIES[name](spark, root).count(), []
            state = "ok" if not problems else "DIFFERS"
        except Exception as error:  # report and go on with the next query
            count, problems, state = -1, [str(error)[:600]], "ERROR"
        failed += bool(problems)
        print(f"{state:8} {name:30} {count:8} rows {time.time() - start:6.1f} s", flush=True)
        for problem in problems:
            print("    ", problem[:1200], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
