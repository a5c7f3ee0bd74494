"""Tables edited file by file: copy-on-write of the files that hold a changed row.

The manifest lists every data file with the smallest and largest key in it.  An edit first drops the files whose key
range cannot match, then finds among the rest, by a scan of the key column alone, those that hold a changed key
(``_metadata.file_path``).  Only these are read whole and written anew; the next version lists the others as they are.
Rows are laid out by key range, so that edits of near keys touch few files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.operators import changes as Ch
from campusflow.operators import listings as Lst
from campusflow.sources import manifest as Mf

def _file() -> Column:
    """A row's data file, by its place below the table's folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(files/[^/]+/[^/]+)$", 1).alias("path")


def _add_files(df: DataFrame, root: str, key: str, n_files: int | None) -> DataFrame:
    """Write ``df`` by ranges of ``key`` into new files; their manifest entries."""
    folder = f"{root}/files/{uuid.uuid4().hex}"
    laid = df.repartitionByRange(n_files, key) if n_files else df.repartitionByRange(key)
    laid.sortWithinPartitions(key).write.mode("errorifexists").parquet(folder)
    return (df.sparkSession.read.parquet(folder).select(key, _file()).groupBy("path")
            .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")))


def create_table(df: DataFrame, root: str, key: str, n_files: int | None = None) -> None:
    """Version 0 of a table at ``root``."""
    if Mf.versions(df.sparkSession, root):
        raise FileExistsError(f"{root} already holds a table")
    df.limit(0).write.mode("overwrite").parquet(f"{root}/schema")
    Mf.commit(_add_files(df, root, key, n_files), root, 0)


def table_files(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """path, low, high and n of the files of a version (default: the newest)."""
    return Mf.manifest(spark, root, Mf.versions(spark, root)[-1] if version is None else version)


def _read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    # the empty table gives the schema where no file is left
    return spark.read.parquet(*[f"{root}/{p}" for p in ["schema", *paths]])


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the newest); the driver handles its list of files, as in any listing."""
    return _read(spark, root, [r["path"] for r in table_files(spark, root, version).select("path").collect()])


def _rewrite(spark: SparkSession, root: str, key: str, files: DataFrame, hit: list[str],
             edit: Callable[[DataFrame], DataFrame]) -> int:
    """The next version: the files in ``hit`` edited and written anew, the others as they are; how many were rewritten."""
    if not hit:
        return 0
    changed = spark.createDataFrame([(p,) for p in hit], "path string")
    new = _add_files(edit(_read(spark, root, hit)), root, key, len(hit))
    entries = files.join(F.broadcast(changed), "path", "left_anti").unionByName(new)
    Mf.commit(entries, root, Mf.versions(spark, root)[-1] + 1)
    return len(hit)


def _files_with(spark: SparkSession, root: str, key: str, keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """(files of the newest version, those of them that hold a row with one of ``keys``, a column of that name)."""
    files = table_files(spark, root)
    keys = keys.select(F.col(key).alias("_wanted")).filter("_wanted is not null").distinct()
    ends = keys.agg(F.min("_wanted").alias("low"), F.max("_wanted").alias("high")).first()
    if ends["low"] is None:
        return files, []
    near = files.filter((F.col("high") >= F.lit(ends["low"])) & (F.col("low") <= F.lit(ends["high"])))
    near = [r["path"] for r in near.select("path").collect()]
    if not near:
        return files, []
    rows = _read(spark, root, near).select(key, _file())
    hit = rows.join(keys, F.col(key) == F.col("_wanted"), "left_semi").select("path").distinct()
    return files, [r["path"] for r in hit.collect()]


def update_table(spark: SparkSession, root: str, changes: DataFrame, key: str = "id", order_by=None) -> int:
    """``update_rows`` on the files that hold a changed key; returns how many files were rewritten."""
    files, hit = _files_with(spark, root, key, changes)
    return _rewrite(spark, root, key, files, hit, lambda part: Ch.update_rows(part, changes, key, order_by))


def delete_from_table(spark: SparkSession, root: str, ids: DataFrame, key: str = "id") -> int:
    """``delete_by_ids`` on the files that hold one of the ids."""
    files, hit = _files_with(spark, root, key, ids)
    return _rewrite(spark, root, key, files, hit, lambda part: Lst.delete_by_ids(part, ids, key))


def purge_table(spark: SparkSession, root: str, col: str, pattern: str, mode: str = "prefix",
                except_pattern: str | None = None, key: str = "id") -> int:
    """``purge_by_key_pattern`` on the files that hold a row that goes."""
    files = table_files(spark, root)
    rows = _read(spark, root, [r["path"] for r in files.select("path").collect()])
    doomed = rows.filter(Ch.purged(col, pattern, mode, except_pattern)).select(_file()).distinct()
    hit = [r["path"] for r in doomed.collect()]
    return _rewrite(spark, root, key, files, hit,
                    lambda part: Ch.purge_by_key_pattern(part, col, pattern, mode, except_pattern))
