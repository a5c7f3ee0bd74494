"""Named reports.  Pattern: pre-aggregate each fact table on the join key
(partial aggregation map-side), then join the small aggregates to the
dimension; never join facts to facts row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.schemas import MONEY_SUM


def _zero_m():
    return F.lit(0).cast(MONEY_SUM)


def _zero_n():
    return F.lit(0).cast("bigint")


def _mean(sum_col, n_col):
    return F.when(F.col(n_col) > 0, F.col(sum_col).cast("double") / F.col(n_col))


def student_stats(students: DataFrame, enrollments: DataFrame, payments: DataFrame) -> DataFrame:
    """Per student: courses enrolled, total paid, total due (pending + overdue), mean progress."""
    e = (enrollments.groupBy(F.col("student_id").alias("_sid"))
         .agg(F.count(F.lit(1)).alias("courses"), F.sum("progress").alias("_p"),
              F.count("progress").alias("_pn")))
    p = (payments.groupBy(F.col("student_id").alias("_pid"))
         .agg(F.sum(F.when(F.col("payment_status") == "paid", F.col("amount"))).alias("_paid"),
              F.sum(F.when(F.col("payment_status") != "paid", F.col("amount"))).alias("_due")))
    j = (students.select("id", "student_id", "name")
         .join(e, F.col("id") == e._sid, "left").join(p, F.col("id") == p._pid, "left"))
    return j.select(F.col("id"), "student_id", "name",
                    F.coalesce("courses", _zero_n()).alias("courses"),
                    F.coalesce(F.col("_paid").cast(MONEY_SUM), _zero_m()).alias("total_paid"),
                    F.coalesce(F.col("_due").cast(MONEY_SUM), _zero_m()).alias("total_due"),
                    _mean("_p", "_pn").alias("mean_progress"))


def course_performance(courses: DataFrame, enrollments: DataFrame, payments: DataFrame) -> DataFrame:
    """Per course: enrolled, completed, completion rate, mean progress, revenue."""
    e = (enrollments.groupBy(F.col("course_id").alias("_cid"))
         .agg(F.count(F.lit(1)).alias("enrolled"),
              F.count(F.when(F.col("status") == "completed", 1)).alias("completed"),
              F.sum("progress").alias("_p"), F.count("progress").alias("_pn")))
    p = payments.groupBy(F.col("course_id").alias("_pc")).agg(F.sum("amount").alias("_rev"))
    j = (courses.select("id", "course_code", "course_name")
         .join(e, F.col("id") == e._cid, "left").join(p, F.col("id") == p._pc, "left"))
    enrolled = F.coalesce("enrolled", _zero_n())
    completed = F.coalesce("completed", _zero_n())
    return j.select("id", "course_code", "course_name", enrolled.alias("enrolled"),
                    completed.alias("completed"),
                    F.when(enrolled > 0, completed.cast("double") / enrolled.cast("double"))
                    .alias("completion_rate"),
                    _mean("_p", "_pn").alias("mean_progress"),
                    F.coalesce(F.col("_rev").cast(MONEY_SUM), _zero_m()).alias("revenue"))


def _period_stats(enrollments: DataFrame, payments: DataFrame, period_of) -> DataFrame:
    e = enrollments.groupBy(period_of("enrollment_date").alias("_pe")).agg(
        F.count(F.lit(1)).alias("enrollments"))
    p = payments.groupBy(period_of("payment_date").alias("_pp")).agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("_rev"))
    j = e.join(p, e._pe == p._pp, "full_outer")
    return j.select(F.coalesce("_pe", "_pp").alias("period"),
                    F.coalesce("enrollments", _zero_n()).alias("enrollments"),
                    F.coalesce("payments", _zero_n()).alias("payments"),
                    F.coalesce(F.col("_rev").cast(MONEY_SUM), _zero_m()).alias("revenue"))


def daily_stats(enrollments: DataFrame, payments: DataFrame) -> DataFrame:
    """Per day with any activity: enrollments, payments, revenue."""
    return _period_stats(enrollments, payments, lambda c: F.col(c)).withColumnRenamed("period", "day")


def monthly_summary(enrollments: DataFrame, payments: DataFrame) -> DataFrame:
    """Per month with any activity: enrollments, payments, revenue."""
    return _period_stats(enrollments, payments, lambda c: F.trunc(c, "MM")).withColumnRenamed("period", "month")


def payment_reminders(payments: DataFrame, students: DataFrame, as_of, pending_days: int = 30) -> DataFrame:
    """Overdue payments, plus pending ones older than ``pending_days`` at ``as_of``, with contact."""
    day = C._date_lit(as_of)
    due = payments.filter((F.col("payment_status") == "overdue") |
                          ((F.col("payment_status") == "pending") &
                           (F.col("payment_date") < F.date_sub(day, pending_days))))
    s = students.select(F.col("id").alias("_sid"), "name", "email", "phone")
    j = due.join(s, due.student_id == s._sid, "left")
    return j.select(F.col("id").alias("payment_id"), "student_id",
                    C.default_value("name", C.NOT_AVAILABLE).alias("student_name"), "email", "phone",
                    "amount", "payment_date", "payment_status",
                    F.datediff(day, F.col("payment_date")).alias("days_outstanding"))


def certificates_due(enrollments: DataFrame, students: DataFrame, courses: DataFrame) -> DataFrame:
    """Enrollments at 100% progress without a certificate yet."""
    done = enrollments.filter((F.col("progress") >= 100) &
                              (F.coalesce(F.col("certificate_url"), F.lit("")) == ""))
    s = students.select(F.col("id").alias("_sid"), "name")
    c = courses.select(F.col("id").alias("_cid"), "course_name")
    j = done.join(s, done.student_id == s._sid, "left").join(c, done.course_id == c._cid, "left")
    return j.select(F.col("id").alias("enrollment_id"), "student_id",
                    C.default_value("name", C.NOT_AVAILABLE).alias("student_name"), "course_id",
                    C.default_value("course_name", C.NOT_AVAILABLE).alias("course_name"),
                    "completion_date")


def balance_due(enrollments: DataFrame, courses: DataFrame, payments: DataFrame) -> DataFrame:
    """Per (student, course) enrolled: course price minus paid payments, never below 0.

    The distinct pairs and the paid sums are both hash-partitioned on
    (student_id, course_id), so they join without another exchange; only
    the course prices are joined on a different key.
    """
    pairs = enrollments.select("student_id", "course_id").distinct()
    paid = (payments.filter(F.col("payment_status") == "paid")
            .groupBy("student_id", "course_id").agg(F.sum("amount").alias("_paid")))
    c = courses.select(F.col("id").alias("_cid"), "price")
    j = (pairs.join(paid, ["student_id", "course_id"], "left")
         .join(c, F.col("course_id") == c._cid, "left"))
    paid_amt = F.coalesce(F.col("_paid").cast(MONEY_SUM), _zero_m())
    price = F.coalesce(F.col("price").cast(MONEY_SUM), _zero_m())
    return j.select("student_id", "course_id", price.alias("price"), paid_amt.alias("paid"),
                    F.greatest(price - paid_amt, _zero_m()).cast(MONEY_SUM).alias("balance"))


def enrollment_stats(enrollments: DataFrame) -> DataFrame:
    """Per (course, status): enrollments and mean progress."""
    g = (enrollments.groupBy("course_id", "status")
         .agg(F.count(F.lit(1)).alias("enrollments"), F.sum("progress").alias("_p"),
              F.count("progress").alias("_pn")))
    return g.select("course_id", "status", "enrollments", _mean("_p", "_pn").alias("mean_progress"))


def recent_activity(audit_log: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` audit rows (top-k, no full sort)."""
    return (audit_log.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n))


def screenshot_review(screenshots: DataFrame, as_of) -> DataFrame:
    """Files awaiting verification per type: count, total size, oldest upload, max age in days.

    The stored table has no size; where no ``file_size`` was joined in, the total is unknown (NULL).
    """
    if "file_size" not in screenshots.columns:
        screenshots = screenshots.withColumn("file_size", F.lit(None).cast("bigint"))
    pend = screenshots.filter(F.col("verification_status") == "pending")
    ts = C._ts_lit(as_of)
    return (pend.groupBy("screenshot_type")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("total_bytes"),
                 F.min("upload_date").alias("oldest_upload"))
            .select("screenshot_type", "files", "total_bytes",
                    F.col("oldest_upload").cast("timestamp_ntz").alias("oldest_upload"),
                    F.datediff(ts, F.col("oldest_upload")).alias("max_age_days"),
                    C.format_file_size("total_bytes").alias("total_size")))
