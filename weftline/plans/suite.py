"""A suite of queries run one after the other, each written and timed; one that fails leaves the others."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_suite(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], out: str) -> DataFrame:
    """name, rows, seconds, error of each query; its result lies in a folder of its name. A report of one row a query."""
    report = []
    for name, query in queries.items():
        began, rows, error = time.time(), None, None
        try:
            query(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
            rows = spark.read.parquet(f"{out}/{name}").count()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        report.append((name, rows, round(time.time() - began, 3), error))
    return spark.createDataFrame(report, "name string, rows bigint, seconds double, error string")
