"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) by its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small file is read by one task, however much is computed on it.

    Tables of more splits than cores stay as they are. Filters and the choice of columns still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table on whose rows much is computed."""
    return spread(table(spark, sf_dir, name))
