"""Registered import/export queries.  Each writes into a fresh folder under the
session's checkpoint directory and returns the data as read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow import schemas
from campusflow.operators import listings as Lst
from campusflow.plans.registry import query
from campusflow.session import checkpoint_dir
from campusflow.sources import files as Fs
from campusflow.sources.adapters import Academy


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PAYMENT_LISTING = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("student_name", T.StringType()),
    T.StructField("course_name", T.StringType()), T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("payment_date", T.DateType()), T.StructField("payment_method", T.StringType()),
    T.StructField("payment_status", T.StringType()), T.StructField("reference_number", T.StringType()),
])


@query("export_import_csv", """
SELECT p.id, coalesce(nullif(s.name, ''), 'N/A') AS student_name,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       p.amount, p.payment_date, p.payment_method, p.payment_status, p.reference_number
FROM payments p LEFT JOIN students s ON p.student_id = s.id LEFT JOIN courses c ON p.course_id = c.id
""")
def q_export_import_csv(spark, sf_dir):
    """Payments listing -> quoted CSV -> typed import; NULLs kept apart with a marker."""
    a = Academy(spark, sf_dir)
    listing = Lst.payments_with_names(a.payments, a.students, a.courses).select(*Lst.PAYMENT_LIST_COLS)
    path = _scratch(spark, "payments-csv")
    Fs.export_csv(listing, path, null_value="\\N")
    good, _ = Fs.import_csv(spark, path, _PAYMENT_LISTING, null_value="\\N", required=["id"])
    return good


@query("import_csv_rejects", """
SELECT doc_id, 'n_chars: not bigint' AS error_text FROM documents WHERE n_chars < 1000
""")
def q_import_csv_rejects(spark, sf_dir):
    """Documents exported as (doc_id, n_chars-as-text) where short ones carry a non-number,
    then imported with n_chars typed BIGINT: exactly those rows are rejected."""
    d = Academy(spark, sf_dir).raw("documents")
    raw = d.select("doc_id", F.when(F.col("n_chars") < 1000, F.concat(F.lit("short:"), F.col("n_chars")))
                   .otherwise(F.col("n_chars").cast("string")).alias("n_chars"))
    path = _scratch(spark, "docs-csv")
    Fs.export_csv(raw, path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())])
    _, rejected = Fs.import_csv(spark, path, schema)
    return rejected.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.array_join("errors", "; ").alias("error_text"))


_DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType())])


@query("import_csv_multi_line", """
WITH d AS (SELECT doc_id, CASE WHEN n_chars % 5 > 0 THEN source END AS source, n_chars, text,
                  concat_ws('; ', CASE WHEN n_chars < 1000 THEN 'n_chars: not bigint' END,
                            CASE WHEN coalesce(CASE WHEN n_chars % 5 > 0 THEN source END, '') = '' THEN 'source is required' END)
                      AS error_text FROM documents)
SELECT doc_id, source, CASE WHEN n_chars < 1000 THEN concat('short:', n_chars) ELSE CAST(n_chars AS VARCHAR) END AS n_chars,
       md5(text) AS text_md5, error_text FROM d
""")
def q_import_csv_multi_line(spark, sf_dir):
    """Whole documents as CSV, their line breaks inside quotes, imported from many splits: the typed rows and the
    rejected ones (a number that is none, a missing source, or both)."""
    d = Academy(spark, sf_dir).raw("documents")
    raw = d.select("doc_id", F.when(F.col("n_chars") % 5 > 0, F.col("source")).alias("source"),
                   F.when(F.col("n_chars") < 1000, F.concat(F.lit("short:"), F.col("n_chars")))
                   .otherwise(F.col("n_chars").cast("string")).alias("n_chars"), "text")
    path = _scratch(spark, "texts-csv")
    Fs.export_csv(raw, path, null_value="\\N")
    good, rejected = Fs.import_csv(spark, path, _DOCUMENT, null_value="\\N", required=["source"], multi_line=True)
    columns = [*[F.col(c).cast("string").alias(c) for c in ("doc_id", "source", "n_chars")], F.md5("text").alias("text_md5")]
    sides = good.select(*columns, F.lit("").alias("error_text")).unionByName(
        rejected.select(*columns, F.array_join("errors", "; ").alias("error_text")))
    return sides.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("export_json", """
SELECT id, course_code, course_name, description, price, start_date FROM courses
""")
def q_export_json(spark, sf_dir):
    c = Academy(spark, sf_dir).courses.select("id", "course_code", "course_name", "description", "price",
                                              "start_date")
    path = _scratch(spark, "courses-json")
    Fs.export_json(c, path)
    schema = T.StructType([f for f in schemas.COURSES.fields if f.name in c.columns])
    return Fs.import_json(spark, path, schema).select(*c.columns)


@query("export_snapshot", """
SELECT 'students' AS table_name, count(*) AS row_count, TIMESTAMP '2024-02-01 12:00:00' AS export_date
FROM students
UNION ALL SELECT 'courses', count(*), TIMESTAMP '2024-02-01 12:00:00' FROM courses
UNION ALL SELECT 'payments', count(*), TIMESTAMP '2024-02-01 12:00:00' FROM payments
""")
def q_export_snapshot(spark, sf_dir):
    a = Academy(spark, sf_dir)
    m = Fs.export_snapshot({"students": a.students, "courses": a.courses, "payments": a.payments},
                           _scratch(spark, "snapshot"), "2024-02-01 12:00:00")
    return m.select("table_name", "row_count", F.col("export_date").cast("timestamp_ntz").alias("export_date"))


@query("catalogue_files", None)
def q_catalogue_files(spark, sf_dir):
    """The test-data folder itself as an upload catalogue (metadata only, content never read)."""
    return Fs.catalogue_files(spark, sf_dir, glob="*.parquet", max_bytes=10 * 1024 * 1024,
                              allowed_ext=["parquet"]).drop("modified")
