"""Table-changing jobs: admissions, keyed upserts, edits, deletes, purges, keep-last-N.

Plain Parquet tables take no MERGE/DELETE, so every job returns the new
version of the table as a DataFrame; the caller writes it to a *new* path
(never the path being read) and switches readers over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.operators.quality import validate_rows
from campusflow.schemas import SETTINGS, STUDENTS
from campusflow.session import checkpoint_dir


def assign_ids(df: DataFrame, order_cols, base: DataFrame | None = None, id_col: str = "id",
               checkpoint: bool = True) -> DataFrame:
    """Dense ids ``max_base + 1 ...`` in ``order_cols`` order, without a global window.

    Rows are range-partitioned and sorted on ``order_cols``, then numbered as
    they lie.  ``base`` is a one-column frame whose maximum is the last used id.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    return number_rows(ordered, base, id_col, checkpoint)


def number_rows(df: DataFrame, base: DataFrame | None = None, id_col: str = "position",
                checkpoint: bool = True) -> DataFrame:
    """Dense numbers in the order in which the rows of a sorted frame lie.

    Each partition's row count gives a running offset (one small row per
    partition, broadcast back).  The numbered rows are checkpointed to the
    shared folder first, so the counts and the numbering see the same rows even
    after an executor is lost.
    """
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mono",
                                                                          F.monotonically_increasing_id())
    if checkpoint:
        checkpoint_dir(df.sparkSession)
        tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    if base is not None:
        start = base.agg(F.coalesce(F.max(base.columns[0]).cast("bigint"), F.lit(0).cast("bigint"))
                         .alias("_n")).select(F.lit(-1).alias("_pid"), "_n")
        counts = counts.unionByName(start)
    # one row per partition (+1): the unpartitioned window is bounded by the partition count
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    j = tagged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return j.withColumn(id_col, (F.col("_off") + local + 1).cast("bigint")).drop("_pid", "_mono", "_off")


# ---- admissions ---------------------------------------------------------------------

ADMISSION_FIELDS = ["student_id", "name", "email", "phone", "address", "course_id", "admission_date"]


def clean_admissions(form: DataFrame) -> DataFrame:
    """Sanitise raw admission form rows (all STRING) into typed columns."""
    return form.select(
        C.sanitize_text("student_id").alias("student_id"),
        C.sanitize_text("name").alias("name"),
        C.sanitize_email("email").alias("email"),
        C.sanitize_text("phone").alias("phone"),
        C.sanitize_text("address", keep_newlines=True).alias("address"),
        C.to_int("course_id").alias("course_id"),
        F.try_to_date(C.sanitize_text("admission_date"), "yyyy-MM-dd").alias("admission_date"),
        *[c for c in form.columns if c not in ADMISSION_FIELDS],
    )


def admit_students(students: DataFrame, form: DataFrame, as_of, order_by: str = "student_id"
                   ) -> dict[str, DataFrame]:
    """Admit a batch of form rows.

    Returns ``students`` (the new rows), ``enrollments`` (one ``active``
    enrollment per new student, dated the admission date) and ``rejected``
    (rows failing validation, with ``errors``).  A code already present in
    ``students`` is skipped.  Of several rows with a code in one batch the
    first by ``order_by``, then by the other fields, wins, so re-running a
    batch admits nobody twice and the outcome does not depend on the row order.
    """
    cleaned = validate_rows(clean_admissions(form), required=["student_id", "name", "email", "phone"],
                            email=["email"], phone=["phone"])
    rejected = cleaned.filter(~F.col("is_valid"))
    good = cleaned.filter(F.col("is_valid")).drop("errors", "is_valid")
    extra = [c for c in good.columns if c not in ADMISSION_FIELDS]
    order = dict.fromkeys([order_by, "name", "email", *ADMISSION_FIELDS])
    rank = F.row_number().over(Window.partitionBy("student_id").orderBy(*[c for c in order if c != "student_id"]))
    first = good.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")
    known = students.select(F.col("student_id").alias("_code"))
    fresh = first.join(known, first.student_id == known._code, "left_anti")
    numbered = assign_ids(fresh, ["student_id"], base=students.select("id"))
    created = C._ts_lit(as_of)
    new_students = numbered.select(
        "id", "student_id", "name", "email", "phone", "address",
        F.col("course_id").cast("bigint").alias("course_id"), "admission_date",
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("profile_image"),
        F.lit(None).cast("string").alias("notes"), created.alias("created_at"))
    enrollments = numbered.select(
        F.col("id").alias("student_id"), F.col("course_id").cast("bigint").alias("course_id"),
        F.col("admission_date").alias("enrollment_date"), F.lit("active").alias("status"))
    return {"students": new_students, "enrollments": enrollments, "rejected": rejected,
            "extra_columns": extra}


def empty_students(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STUDENTS)


# ---- settings upsert ----------------------------------------------------------------

def upsert_settings(current: DataFrame, changes: DataFrame, last_id: int | None = None) -> DataFrame:
    """Apply (setting_key, setting_value, changed_at, seq) changes to a settings table.

    Per key the last change by (changed_at, seq) wins.  Present keys get the
    new value and ``updated_at``, keeping ``created_at``; new keys get both
    stamps and fresh ids; keys without a change are unchanged.  NULL is a key
    like any other.  ``last_id`` is the last id in use where ``current`` is but a
    part of the table.
    """
    newest = Window.partitionBy("setting_key").orderBy(F.col("changed_at").desc_nulls_last(),
                                                       F.col("seq").desc_nulls_last())
    last = (changes.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1)
            .select("setting_key", F.struct("setting_value", "changed_at").alias("_c")))
    cur = current.select(F.col("id").alias("_id"), F.col("setting_key").alias("_k"),
                         F.col("setting_value").alias("_v"), F.col("created_at").alias("_created"),
                         F.col("updated_at").alias("_updated"))
    j = cur.join(last, cur._k.eqNullSafe(last.setting_key), "full_outer")
    changed = F.col("_c").isNotNull()
    merged = j.select(
        "_id",
        F.coalesce("_k", "setting_key").alias("setting_key"),
        F.when(changed, F.col("_c.setting_value")).otherwise(F.col("_v")).alias("setting_value"),
        F.coalesce("_created", "_c.changed_at").alias("created_at"),
        F.when(changed, F.col("_c.changed_at")).otherwise(F.col("_updated")).alias("updated_at"))
    # read twice (kept rows, new keys): checkpoint the joined table once instead of joining twice
    checkpoint_dir(current.sparkSession)
    merged = merged.checkpoint(eager=True)
    kept = merged.filter(F.col("_id").isNotNull()).withColumnRenamed("_id", "id")
    base = current.select("id") if last_id is None else current.sparkSession.createDataFrame([(last_id,)], "id long")
    new = assign_ids(merged.filter(F.col("_id").isNull()).drop("_id"), ["setting_key"], base=base)
    return kept.unionByName(new.select(*kept.columns))


def empty_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SETTINGS)


# ---- edits, deletes, purges, retention ----------------------------------------------

def update_rows(df: DataFrame, changes: DataFrame, key: str = "id", order_by=None) -> DataFrame:
    """Overwrite the columns present in ``changes`` for the rows whose ``key`` matches.

    A NULL in a change keeps the old value.  Of several changes of a key the
    last by ``order_by`` applies, all of it; without an order they are compared
    by their values, so the outcome does not depend on the row order.
    """
    cols = [c for c in changes.columns if c != key and c in df.columns]
    order = [order_by] if isinstance(order_by, str) else list(order_by or cols)
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order + cols])
    changes = changes.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1)
    ch = changes.select(F.col(key).alias("_key"), *[F.col(c).alias("_new_" + c) for c in cols])
    j = df.join(ch, df[key] == ch._key, "left")
    return j.select(*[F.coalesce(F.col("_new_" + c), F.col(c)).cast(df.schema[c].dataType).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def purged(col: str, pattern: str, mode: str = "prefix", except_pattern: str | None = None) -> Column:
    """Whether ``purge_by_key_pattern`` deletes a row; never NULL."""
    def match(p):
        if mode == "prefix":
            return F.col(col).startswith(p[:-1] if p.endswith("%") else p)
        if mode == "like":
            return F.col(col).like(p)
        raise ValueError("mode is 'prefix' or 'like'")

    pred = match(pattern)
    if except_pattern is not None:
        pred = pred & ~F.coalesce(match(except_pattern), F.lit(False))
    return F.coalesce(pred, F.lit(False))


def purge_by_key_pattern(df: DataFrame, col: str, pattern: str, mode: str = "prefix",
                         except_pattern: str | None = None) -> DataFrame:
    """Survivors after deleting rows whose ``col`` matches ``pattern``.

    ``mode='prefix'`` treats ``pattern`` (minus a trailing ``%``) as a literal
    prefix; ``mode='like'`` is SQL LIKE, where ``_`` is a wildcard.  NULL keys
    survive.  Rows matching ``except_pattern`` (same mode) survive too.
    """
    return df.filter(~purged(col, pattern, mode, except_pattern))


def keep_last_n(df: DataFrame, keys, ts: str, tiebreak: str, n: int = 10) -> DataFrame:
    """The newest ``n`` rows per key (ties broken by ``tiebreak`` descending).

    ``row_number() <= n`` plans a partial ``WindowGroupLimit`` before the
    shuffle, so a hot key ships at most ``n`` rows per map task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    w = w.orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def append_keep_last_n(log: DataFrame, new: DataFrame, keys, ts: str, tiebreak: str,
                       n: int = 10) -> DataFrame:
    return keep_last_n(log.unionByName(new), keys, ts, tiebreak, n)


def drop_dataset(spark: SparkSession, tables, confirm: bool = False) -> list[str]:
    """``DROP TABLE IF EXISTS`` for each listed table; nothing happens without ``confirm``."""
    if not confirm:
        raise ValueError("drop_dataset needs confirm=True")
    dropped = []
    for t in tables:
        if spark.catalog.tableExists(t):
            dropped.append(t)
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    return dropped
