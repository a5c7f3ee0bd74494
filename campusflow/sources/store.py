"""Physical layout of the entity tables for large data.

* Fact tables are partitioned by month (``payment_month``, ``enrollment_month``),
  so a date-range query also filters the month column and Spark reads only
  the matching directories (``PartitionFilters`` in the scan).
* Tables joined on the student key are bucketed on it with the same bucket
  count, so ``student_stats``-style joins and per-student aggregates run
  without an exchange on either side (``saveAsTable`` with an explicit path
  in the shared folder; the catalog only keeps the bucket spec).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.session import checkpoint_dir
from campusflow.sources import manifest as Mf

MONTH_COLUMNS = {"payment_date": "payment_month", "enrollment_date": "enrollment_month"}


def with_month(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumn(MONTH_COLUMNS[date_col], F.trunc(F.col(date_col), "MM"))


def write_by_month(df: DataFrame, path: str, date_col: str, mode: str = "errorifexists") -> None:
    """Write ``df`` partitioned by the month of ``date_col`` (one directory per month).

    The rows are rebalanced by month: AQE writes a small month from one task
    and splits a large one over as many as the advisory partition size asks for.
    """
    month = MONTH_COLUMNS[date_col]
    (with_month(df, date_col).hint("rebalance", month).write.mode(mode).partitionBy(month).parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None,
                   mode: str = "errorifexists") -> DataFrame:
    """Save ``df`` as table ``table``, bucketed and sorted on ``key``: in the warehouse, where dropping
    the table removes its files, or at ``path``."""
    w = df.write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)


def month_filter(df: DataFrame, date_col: str, lo, hi) -> DataFrame:
    """``lo <= date_col < hi``, plus the same range on the month partition column when the
    table carries one (so the directories outside the range are never listed or read)."""
    out = df.filter((F.col(date_col) >= lo) & (F.col(date_col) < hi))
    month = MONTH_COLUMNS.get(date_col)
    if month and month in df.columns:
        out = out.filter((F.col(month) >= F.trunc(lo, "MM")) & (F.col(month) < hi))
    return out


def stored_once(source: DataFrame, name: str, write) -> str:
    """The folder of a layout of ``source``, written by ``write(path)`` unless one of the same files is there.

    The folder's name has a hash of the source's files with their sizes and times, so a changed source gets a layout of
    its own; a layout counts once its manifest is in place, so one that was not finished is written again.
    """
    spark = source.sparkSession
    facts = []
    for path in sorted(source.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        facts.append((path, status.getLen(), status.getModificationTime()))
    root = f"{checkpoint_dir(spark).rstrip('/')}/layout-{name}-{hashlib.md5(repr(facts).encode()).hexdigest()}"
    if not Mf.versions(spark, root):
        Mf.delete_path(spark, f"{root}/data")
        write(f"{root}/data")
        Mf.commit(spark.createDataFrame([("data",)], "path string"), root, 0)
    return f"{root}/data"


def bucketed_once(source: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """``source`` as an external table bucketed on ``key``, written once (see ``stored_once``) and registered if need be."""
    spark = source.sparkSession
    scratch = f"cf_write_{uuid.uuid4().hex[:12]}"

    def write(path):
        write_bucketed(source, scratch, key, buckets, path)
        spark.sql(f"DROP TABLE {scratch}")  # external: the files stay
    path = stored_once(source, f"{table}-{key}-{buckets}", write)
    name = f"cf_{table}_{hashlib.md5(path.encode()).hexdigest()[:12]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
