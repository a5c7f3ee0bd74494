"""Readers: the entity tables and the driver's test tables.

``scan_table`` reads one entity table with an explicit schema; Catalyst prunes
columns and pushes filters into the Parquet scan, so callers select late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from campusflow import schemas

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scan_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """Full read of one entity table.  ``schema`` may be a StructType or an entity name."""
    if isinstance(schema, str):
        schema = schemas.BY_NAME[schema]
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TEST_TABLES:
        raise ValueError(f"unknown test table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
