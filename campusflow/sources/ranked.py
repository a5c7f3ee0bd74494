"""Listings stored in their order, with a directory of ranks: any page is read from the one or two files that hold it.

The rows are range-partitioned and sorted once and written in files of bounded size.  The directory has one row per
file: how many rows come before it, and how many it has.  A page by number then is a look into the directory and a
sort of at most two files' rows, at whatever depth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campusflow.sources import manifest as Mf

#: Rows of a file.
FILE_ROWS = 100_000


def _order(order_by: str) -> list:
    """Sort columns of ``name`` or ``-name`` (descending), comma-joined; nulls come last."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order_by.split(",")]


def write_ranked(df: DataFrame, root: str, order_by: str, file_rows: int = FILE_ROWS) -> None:
    """Store ``df`` at ``root`` in the order of ``order_by`` (``-payment_date,id``), which must leave no ties."""
    spark, order = df.sparkSession, _order(order_by)
    (df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists")
     .option("maxRecordsPerFile", file_rows).parquet(f"{root}/files"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"files/([^/]+)$", 1)
    sizes = spark.read.parquet(f"{root}/files").select(name.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # files are named after their partition and their turn in it; the window has one row per file
    place = [F.regexp_extract("name", r"^part-(\d+)-", 1).cast("long"), F.regexp_extract("name", r"-c(\d+)\.", 1).cast("long")]
    before = F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
    Mf.commit(sizes.select(F.concat(F.lit("files/"), "name").alias("path"), F.coalesce(before, F.lit(0)).alias("first_row"), "n",
                           F.lit(order_by).alias("order_by")), root, 0)


def count_rows(spark: SparkSession, root: str) -> int:
    return Mf.manifest(spark, root, 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def count_pages(spark: SparkSession, root: str, per_page: int) -> int:
    return math.ceil(count_rows(spark, root) / per_page)


def ranked_page(spark: SparkSession, root: str, page: int, per_page: int = 20) -> DataFrame:
    """Page ``page`` (from 1) with ``row_no``, as ``page_rows`` gives it; a page behind the last has no rows."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    low = (page - 1) * per_page
    near = Mf.manifest(spark, root, 0).filter((F.col("first_row") < low + per_page) & (F.col("first_row") + F.col("n") > low))
    files = sorted(near.collect(), key=lambda r: r["first_row"])  # those that hold the page
    if not files:
        empty = spark.read.parquet(f"{root}/files").limit(0)
        return empty.withColumn("row_no", F.lit(None).cast("bigint"))
    order, first = _order(files[0]["order_by"]), files[0]["first_row"]
    rows = spark.read.parquet(*[f"{root}/{f['path']}" for f in files]).orderBy(*order).offset(low - first).limit(per_page)
    # the window numbers one page
    return rows.withColumn("row_no", (F.row_number().over(Window.orderBy(*order)) + F.lit(low)).cast("bigint"))
