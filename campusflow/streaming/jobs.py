"""Structured Streaming jobs: arrival-driven admissions, settings upserts, the audit log.

Sinks are made safe for replays: a micro-batch may run twice after a
failure, so every ``foreachBatch`` body is idempotent by construction: what a
batch writes is named after the stream and the batch and written over, and a
replay starts from the state before the batch.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow.operators import changes as Ch
from campusflow.schemas import ENROLLMENTS, SETTINGS, STUDENTS
from campusflow.session import checkpoint_dir
from campusflow.sources import code_index as Ci
from campusflow.sources import manifest as Mf


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain a bounded stream (``availableNow``) in append mode into Parquet at ``path`` and read it back.

    Aggregates need a watermark and give their closed groups; the state of these is freed.
    """
    q = (df.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- admissions -------------------------------------------------------------------------

def init_table(spark: SparkSession, path: str, schema, partition_by=None) -> None:
    """Create an empty table at ``path`` unless one exists (``mode('ignore')``)."""
    w = spark.createDataFrame([], schema).write.mode("ignore")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


#: A student row as stored by the stream: which micro-batch admitted it.
_ADMITTED = T.StructType(STUDENTS.fields + [T.StructField("admitted_in", T.LongType())])


def admit_batch(spark: SparkSession, batch: DataFrame, students_path: str, enrollments_path: str,
                as_of, batch_id: int = 0, rejected_path: str | None = None, stream: str = "stream") -> None:
    """One micro-batch of admission forms -> added students, their enrollments, and the rejects.

    Which codes are known is asked of the code index below the students' folder (built from the students on first
    use), so a batch without a known code reads no student, and one with some reads the codes of their buckets.  Students
    admitted in another way must be followed by ``rebuild_code_index``.

    Everything a batch writes is named after the stream and the batch and written over by a replay, which starts
    from the index as it was before the batch: a crash between any two writes leaves nothing double.
    """
    init_table(spark, students_path, STUDENTS)
    init_table(spark, enrollments_path, ENROLLMENTS)
    index, name = f"{students_path}/_codes", f"{stream}-{batch_id}"
    if not Mf.versions(spark, index):
        rebuild_code_index(spark, students_path)
    before, version = Mf.base_of(spark, index, name)
    found = Ci.entries(spark, index, before)
    codes = Ch.clean_admissions(batch).select(F.col("student_id").alias("code")).filter("code is not null")
    hit = Ci.hit_buckets(spark, index, found, codes, Ci.BUCKETS)
    known = Ci.codes_of(spark, index, found, hit).select(F.col("code").alias("student_id"), "id")
    last = spark.createDataFrame([(None, Ci.last_id(found))], "student_id string, id long")
    out = Ch.admit_students(known.unionByName(last), batch, as_of)
    admitted = out["students"].withColumn("admitted_in", F.lit(batch_id).cast("bigint"))
    Mf.publish(admitted, students_path, name)
    if rejected_path:
        out["rejected"].drop("is_valid").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
    Mf.publish(out["students"].select(
        F.col("id").alias("id"), F.col("id").alias("student_id"), "course_id",
        F.col("admission_date").alias("enrollment_date"), F.lit(None).cast("date").alias("completion_date"),
        F.lit("active").alias("status"), F.lit(None).cast("decimal(5,2)").alias("progress"),
        F.lit(None).cast("string").alias("grade"), F.lit(None).cast("string").alias("certificate_url"),
    ), enrollments_path, name)
    Ci.add_codes(spark, index, found, out["students"].select(F.col("student_id").alias("code"), "id"), version, name)


def rebuild_code_index(spark: SparkSession, students_path: str) -> None:
    """Make the code index anew from all students; also how an existing table gets one."""
    students = spark.read.schema(STUDENTS).parquet(students_path)
    index = f"{students_path}/_codes"
    known = Mf.versions(spark, index)
    version = known[-1] + 1 if known else 0
    Ci.add_codes(spark, index, [], students.select(F.col("student_id").alias("code"), "id").filter("code is not null"),
                 version, f"rebuilt-{uuid.uuid4().hex}")


def stream_admissions(forms: DataFrame, students_path: str, enrollments_path: str, checkpoint: str,
                      as_of, watermark: str | None = None, event_time: str | None = None,
                      rejected_path: str | None = None):
    """Start the admissions stream; duplicate codes inside the watermark are dropped first.

    The checkpoint's path names the stream."""
    df = forms
    if watermark and event_time:
        df = df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["student_id"])
    spark, name = forms.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()
    return (df.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, bid: admit_batch(spark, b, students_path, enrollments_path, as_of, bid,
                                                     rejected_path, name))
            .trigger(availableNow=True).start())


# ---- settings upserts -------------------------------------------------------------------

SETTING_BUCKETS = 32
#: Versions that are kept: the newest and the one before, from which a replay starts.
KEEP_VERSIONS = 2
_BUCKET_ENTRY = "bucket int, path string, n long, max_id long, writer string"


def upsert_batch(spark: SparkSession, batch: DataFrame, settings_root: str, batch_id: int,
                 stream: str = "stream") -> None:
    """Apply one batch of changes on top of the version before it and make the next version.

    Settings lie in buckets by a hash of their key.  Only the buckets that the batch touches are read, merged and
    written, into a folder of the batch; the manifest of the new version names the others as they are, and versions
    before the last are removed with what only they name.  A version belongs to a batch of a stream, so a replay makes
    the same version again, and a stream with a fresh checkpoint continues after the newest one.
    """
    checkpoint_dir(spark)
    name = f"{stream}-{batch_id}"
    before, version = Mf.base_of(spark, settings_root, name)
    found = Mf.manifest(spark, settings_root, before).collect() if before is not None else []  # one row per bucket
    bucket = F.pmod(F.xxhash64("setting_key"), F.lit(SETTING_BUCKETS)).cast("int")
    touched = {r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()}
    if not touched:
        return
    current = _settings(spark, settings_root, [e for e in found if e["bucket"] in touched])
    new = Ch.upsert_settings(current, batch, max((e["max_id"] for e in found), default=0))
    folder = f"data/{name}"
    (new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{settings_root}/{folder}"))
    facts = spark.read.parquet(f"{settings_root}/{folder}").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id")).collect()
    entries = [(e["bucket"], e["path"], e["n"], e["max_id"], name) for e in found if e["bucket"] not in touched]
    entries += [(f["bucket"], f"{folder}/bucket={f['bucket']}", f["n"], f["max_id"], name) for f in facts]
    Mf.commit(spark.createDataFrame(entries, _BUCKET_ENTRY), settings_root, version)
    Mf.retire(spark, settings_root, KEEP_VERSIONS)


def _settings(spark: SparkSession, root: str, entries: list) -> DataFrame:
    if not entries:
        return Ch.empty_settings(spark)
    return spark.read.schema(SETTINGS).parquet(*[f"{root}/{e['path']}" for e in entries])


def latest_settings(spark: SparkSession, settings_root: str) -> DataFrame:
    known = Mf.versions(spark, settings_root)
    return _settings(spark, settings_root, Mf.manifest(spark, settings_root, known[-1]).collect() if known else [])


def stream_upsert(changes: DataFrame, settings_root: str, checkpoint: str):
    """Apply setting changes as they arrive; the checkpoint's path names the stream."""
    spark, name = changes.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()
    return (changes.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda b, bid: upsert_batch(spark, b, settings_root, bid, name))
            .trigger(availableNow=True).start())


# ---- audit log ----------------------------------------------------------------------------

def stream_audit(events: DataFrame, sink: str, checkpoint: str):
    """Append the activity log: file source -> Parquet sink (exactly-once via the sink log)."""
    log = events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
                        "user_id", F.col("event_type").alias("action"),
                        F.lit("academy").alias("plugin"), F.lit("1.0.0").alias("version"))
    return (log.writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_log(new: DataFrame, root: str, keys, ts: str, tiebreak: str, writer: str, n: int = 10) -> None:
    """Append rows to the stored log at ``root`` and trim it to the newest ``n`` per key, as one version.

    ``writer`` names the batch: a replay makes its version again from the one before.  The log is small by its bound, so
    it is written whole; versions before the last are removed.
    """
    spark = new.sparkSession
    before, version = Mf.base_of(spark, root, writer)
    if before is not None:
        entry = Mf.manifest(spark, root, before).first()
        log = Ch.append_keep_last_n(spark.read.parquet(f"{root}/{entry['path']}"), new, keys, ts, tiebreak, n)
    else:
        log = Ch.keep_last_n(new, keys, ts, tiebreak, n)
    log.write.mode("overwrite").parquet(f"{root}/data/{writer}")
    Mf.commit(spark.createDataFrame([(f"data/{writer}", writer)], "path string, writer string"), root, version)
    Mf.retire(spark, root, KEEP_VERSIONS)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    entry = Mf.manifest(spark, root, Mf.versions(spark, root)[-1]).first()
    return spark.read.parquet(f"{root}/{entry['path']}")
