"""Registration of queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that comes in fewer splits than there are cores over all cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None):
    """Register f(t, spark), where t(name) reads a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)

            def table(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return spread(df) if name == "documents" else df

            return f(table, spark)

        run.__name__, run.__doc__ = name, f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add
