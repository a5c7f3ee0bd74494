"""CSV / JSON import and export, snapshots and the uploaded-file catalogue.

Writers go through ``DataFrameWriter`` (one file per partition, written in
parallel, committed atomically per job); readers take explicit schemas.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.functions import columns as C
from campusflow.operators.quality import validate_rows
from campusflow.sources import manifest as Mf
from campusflow.sources.csv_records import csv_records


#: Holds a line whose fields do not fit the schema, and what is said of it.
LINE, MSG_FIELDS = "_line", "wrong number of fields"


def export_csv(df: DataFrame, path: str, header: bool = True, null_value: str | None = None,
               mode: str = "errorifexists") -> None:
    """Every value double-quoted, embedded quotes doubled (``a"b`` -> ``"a""b"``).

    With ``quoteAll`` NULL and '' both read back as NULL; pass ``null_value``
    (a marker such as ``\\N``) to keep them apart on a round trip.
    """
    w = (df.write.mode(mode).option("header", header).option("quoteAll", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if null_value is not None:
        w = w.option("nullValue", null_value)
    w.csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
               null_value: str | None = None, required=(), email=(), phone=(),
               multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Load CSV into ``schema`` -> (good typed rows, rejected raw rows with ``errors``).

    Every field is read as text and converted with ``try_cast``, so a value
    that does not fit its type is reported by name (``n_chars: not bigint``)
    instead of vanishing; CSV column pruning cannot skip the check.  A line with
    more or fewer fields than the schema is rejected whole, with the line as
    read in ``line``.  The typed rows then go through ``validate_rows``.  ``multi_line`` reads quoted
    values that contain line breaks; files stay splittable (see ``csv_records``), at
    the price of further scans, so it is off unless the data needs it.
    """
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields]
                               + [T.StructField(LINE, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "escape": '"'}
    if null_value is not None:
        options["nullValue"] = null_value
    if multi_line:
        record = F.from_csv("value", text_schema.toDDL(), {**options, "multiLine": "true"})
        raw = csv_records(spark, path, header).select(record.alias("_record")).select("_record.*")
    else:
        raw = spark.read.schema(text_schema).options(header=header, **options).csv(path)
    typed, bad_type = [], []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            typed.append(c.alias(f.name))
            continue
        conv = c.try_cast(f.dataType)
        typed.append(conv.alias(f.name))
        bad_type.append(F.when(c.isNotNull() & conv.isNull(),
                               F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
    conv_errors = F.array_compact(F.array(F.when(F.col(LINE).isNotNull(), F.lit(MSG_FIELDS)), *bad_type))
    staged = raw.select(*[F.col(f.name).alias("_raw_" + f.name) for f in schema.fields],
                        *typed, conv_errors.alias("_conv_errors"), F.col(LINE))
    checked = validate_rows(staged, required=required, email=email, phone=phone)
    checked = (checked.withColumn("errors", F.concat("_conv_errors", "errors"))
               .withColumn("is_valid", F.size("errors") == 0))
    good = checked.filter(F.col("is_valid")).select(*[f.name for f in schema.fields])
    rejected = checked.filter(~F.col("is_valid")).select(
        *[F.col("_raw_" + f.name).alias(f.name) for f in schema.fields], "errors", F.col(LINE).alias("line"))
    return good, rejected


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, one object per row (a pretty single document does not scale)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def import_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_snapshot(tables: dict[str, DataFrame], root: str, as_of, fmt: str = "parquet") -> DataFrame:
    """Write the tables stamped with ``export_date`` as one snapshot; return (table_name, row_count, export_date).

    Every table goes to a new folder, and the manifest that lists them all with their files' row counts is put in place
    last: if a table fails, there is no snapshot, and one from before stays the newest.
    """
    stamp, folder = C._ts_lit(as_of), f"files/{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("export_date", stamp).write.mode("errorifexists").format(fmt).save(f"{root}/{folder}/{name}")
    parts = []
    for name in tables:
        written = spark.read.format(fmt).load(f"{root}/{folder}/{name}")
        parts.append(written.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", stamp.alias("export_date"),
            F.lit(f"{folder}/{name}").alias("path"), F.lit(fmt).alias("format")))
    known = Mf.versions(spark, root)
    version = known[-1] + 1 if known else 0
    Mf.commit(functools.reduce(DataFrame.unionByName, parts), root, version)
    return snapshot_tables(spark, root, version).select("table_name", "row_count", "export_date")


def snapshot_tables(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The manifest of a snapshot (default: the newest whole one)."""
    return Mf.manifest(spark, root, Mf.versions(spark, root)[-1] if version is None else version)


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as the snapshot has it."""
    entry = snapshot_tables(spark, root, version).filter(F.col("table_name") == name).first()
    if entry is None:
        raise KeyError(f"the snapshot has no table {name!r}")
    return spark.read.format(entry["format"]).load(f"{root}/{entry['path']}")


def catalogue_files(spark: SparkSession, path: str, glob: str | None = None,
                    max_bytes: int | None = None, allowed_ext=None) -> DataFrame:
    """Uploaded files as rows: path, file_name, extension, size, readable size, modified.

    Only metadata columns are selected, so the ``binaryFile`` source never reads
    file content.  ``max_bytes`` / ``allowed_ext`` become flags, not filters,
    so nothing disappears silently.
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    ok = F.lit(True)
    if max_bytes is not None:
        ok = ok & (F.col("length") <= max_bytes)
    if allowed_ext:
        ok = ok & ext.isin([e.lower() for e in allowed_ext])
    return files.select("path", name.alias("file_name"), ext.alias("extension"),
                        F.col("length").alias("size"), C.format_file_size("length").alias("size_display"),
                        F.col("modificationTime").alias("modified"), ok.alias("accepted"))
