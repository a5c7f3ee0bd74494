"""Versioned manifests: which files make up a version of a table, written last and in one piece.

A table folder holds data files, which never change, and one small Parquet file per version under ``manifest/``.
Writers add data files first; the version exists once its manifest file is in place, so a failed job leaves the
version before it as it was.  One writer at a time; readers keep to the version they began with.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any file system that Spark reads."""
    files, target = _folder(spark, path)
    files.delete(target, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first; folders of writers that failed hold no file and do not count."""
    files, target = _folder(spark, f"{root}/manifest")
    if not files.exists(target):
        return []
    found = []
    for entry in files.listStatus(target):
        name = entry.getPath().getName()
        if name.startswith("version=") and any(f.getPath().getName().endswith(".parquet")
                                               for f in files.listStatus(entry.getPath())):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest/version={version}")


def base_of(spark: SparkSession, root: str, writer: str) -> tuple[int | None, int]:
    """(the version that ``writer`` builds on, or none, and the version it makes); ``writer`` names a batch of a stream.

    A writer whose version is the newest is a replay: it makes its own version again from the one before.
    """
    known = versions(spark, root)
    if not known:
        return None, 0
    first = manifest(spark, root, known[-1]).select("writer").first()
    if first is not None and first["writer"] == writer:
        return (known[-2] if len(known) > 1 else None), known[-1]
    return known[-1], known[-1] + 1


def commit(entries: DataFrame, root: str, version: int) -> None:
    """Make ``entries`` (one row per file, or per group of files) the manifest of ``version``, as one file."""
    entries.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def retire(spark: SparkSession, root: str, keep: int, path_col: str = "path") -> None:
    """Remove all but the newest ``keep`` versions, and the files that only they name (relative to ``root``).

    A blank path names no file: a manifest without files has such a row, which says who wrote it."""
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    if not old:
        return

    def named(numbers):
        frames = [manifest(spark, root, v).select(path_col) for v in numbers]
        return functools.reduce(DataFrame.unionByName, frames).filter(F.col(path_col) != "").distinct()

    # the manifests go last, so that a run that fails here is made up for by the next
    for r in named(old).join(named(kept), path_col, "left_anti").toLocalIterator():
        delete_path(spark, f"{root}/{r[path_col]}")
    for v in old:
        delete_path(spark, f"{root}/manifest/version={v}")


def publish(df: DataFrame, path: str, name: str) -> None:
    """Add ``df`` to the flat table at ``path`` as files that begin with ``name``, in place of an earlier run's.

    The files are written aside and then renamed one by one, as a job's commit does.
    """
    spark = df.sparkSession
    staged = f"{path}/_staged/{name}"
    df.write.mode("overwrite").parquet(staged)
    files, target = _folder(spark, path)
    fresh = [e.getPath() for e in files.listStatus(_folder(spark, staged)[1]) if e.getPath().getName().endswith(".parquet")]
    for entry in files.listStatus(target):
        if entry.getPath().getName().startswith(f"{name}-part-"):
            files.delete(entry.getPath(), False)
    for number, source in enumerate(sorted(fresh, key=str)):
        if not files.rename(source, _folder(spark, f"{path}/{name}-part-{number:05d}.parquet")[1]):
            raise OSError(f"could not move {source}")
    delete_path(spark, staged)
