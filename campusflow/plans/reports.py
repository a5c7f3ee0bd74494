"""Registered named reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from campusflow.operators import reports as R
from campusflow.plans.registry import AS_OF_SALES, query
from campusflow.sources.adapters import Academy
from campusflow.sources.store import bucketed_once

_D = AS_OF_SALES[:10]


@query("student_stats", """
SELECT s.id, s.student_id, s.name, coalesce(e.courses, 0) AS courses,
       CAST(coalesce(p.paid, 0) AS DECIMAL(38,2)) AS total_paid,
       CAST(coalesce(p.due, 0) AS DECIMAL(38,2)) AS total_due,
       CASE WHEN e.pn > 0 THEN CAST(e.ps AS DOUBLE) / e.pn END AS mean_progress
FROM students s
LEFT JOIN (SELECT student_id, count(*) AS courses, sum(progress) AS ps, count(progress) AS pn
           FROM enrollments GROUP BY student_id) e ON s.id = e.student_id
LEFT JOIN (SELECT student_id, sum(amount) FILTER (WHERE payment_status = 'paid') AS paid,
                  sum(amount) FILTER (WHERE payment_status <> 'paid') AS due
           FROM payments GROUP BY student_id) p ON s.id = p.student_id
""")
def q_student_stats(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.student_stats(a.students, a.enrollments, a.payments)


@query("course_performance", """
SELECT c.id, c.course_code, c.course_name, coalesce(e.enrolled, 0) AS enrolled,
       coalesce(e.completed, 0) AS completed,
       CASE WHEN coalesce(e.enrolled, 0) > 0 THEN CAST(e.completed AS DOUBLE) / e.enrolled END
         AS completion_rate,
       CASE WHEN e.pn > 0 THEN CAST(e.ps AS DOUBLE) / e.pn END AS mean_progress,
       CAST(coalesce(p.rev, 0) AS DECIMAL(38,2)) AS revenue
FROM courses c
LEFT JOIN (SELECT course_id, count(*) AS enrolled, count(*) FILTER (WHERE status = 'completed') AS completed,
                  sum(progress) AS ps, count(progress) AS pn FROM enrollments GROUP BY course_id) e
  ON c.id = e.course_id
LEFT JOIN (SELECT course_id, sum(amount) AS rev FROM payments GROUP BY course_id) p ON c.id = p.course_id
""")
def q_course_performance(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.course_performance(a.courses, a.enrollments, a.payments)


def _period_sql(expr_e, expr_p, name):
    return f"""
SELECT coalesce(e.k, p.k) AS {name}, coalesce(e.n, 0) AS enrollments, coalesce(p.n, 0) AS payments,
       CAST(coalesce(p.rev, 0) AS DECIMAL(38,2)) AS revenue
FROM (SELECT {expr_e} AS k, count(*) AS n FROM enrollments GROUP BY 1) e
FULL OUTER JOIN (SELECT {expr_p} AS k, count(*) AS n, sum(amount) AS rev FROM payments GROUP BY 1) p
  ON e.k = p.k
"""


@query("daily_stats", _period_sql("enrollment_date", "payment_date", "day"))
def q_daily_stats(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.daily_stats(a.enrollments, a.payments)


@query("monthly_summary", _period_sql("CAST(date_trunc('month', enrollment_date) AS DATE)",
                                      "CAST(date_trunc('month', payment_date) AS DATE)", "month"))
def q_monthly_summary(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.monthly_summary(a.enrollments, a.payments)


@query("payment_reminders", f"""
SELECT p.id AS payment_id, p.student_id, coalesce(nullif(s.name, ''), 'N/A') AS student_name, s.email, s.phone,
       p.amount, p.payment_date, p.payment_status,
       CAST(DATE '{_D}' - p.payment_date AS INTEGER) AS days_outstanding
FROM payments p LEFT JOIN students s ON p.student_id = s.id
WHERE p.payment_status = 'overdue'
   OR (p.payment_status = 'pending' AND p.payment_date < DATE '{_D}' - INTERVAL 30 DAY)
""")
def q_payment_reminders(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.payment_reminders(a.payments, a.students, AS_OF_SALES, 30)


@query("certificates_due", """
SELECT e.id AS enrollment_id, e.student_id, coalesce(nullif(s.name, ''), 'N/A') AS student_name, e.course_id,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name, e.completion_date
FROM enrollments e LEFT JOIN students s ON e.student_id = s.id LEFT JOIN courses c ON e.course_id = c.id
WHERE e.progress >= 100 AND coalesce(e.certificate_url, '') = ''
""")
def q_certificates_due(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.certificates_due(a.enrollments, a.students, a.courses)


@query("balance_due", """
SELECT e.student_id, e.course_id, CAST(coalesce(c.price, 0) AS DECIMAL(38,2)) AS price,
       CAST(coalesce(p.paid, 0) AS DECIMAL(38,2)) AS paid,
       CAST(greatest(coalesce(c.price, 0) - coalesce(p.paid, 0), 0) AS DECIMAL(38,2)) AS balance
FROM (SELECT DISTINCT student_id, course_id FROM enrollments) e
LEFT JOIN courses c ON e.course_id = c.id
LEFT JOIN (SELECT student_id, course_id, sum(amount) AS paid FROM payments WHERE payment_status = 'paid'
           GROUP BY 1, 2) p ON e.student_id = p.student_id AND e.course_id = p.course_id
""")
def q_balance_due(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return R.balance_due(a.enrollments, a.courses, a.payments)


@query("enrollment_stats", """
SELECT course_id, status, count(*) AS enrollments,
       CASE WHEN count(progress) > 0 THEN CAST(sum(progress) AS DOUBLE) / count(progress) END AS mean_progress
FROM enrollments GROUP BY 1, 2
""")
def q_enrollment_stats(spark, sf_dir):
    return R.enrollment_stats(Academy(spark, sf_dir).enrollments)


@query("recent_activity", """
SELECT id, "timestamp", user_id, action FROM audit_log ORDER BY "timestamp" DESC, id DESC LIMIT 10
""")
def q_recent_activity(spark, sf_dir):
    log = Academy(spark, sf_dir).audit_log
    return R.recent_activity(log, 10).select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                                             "user_id", "action")


@query("screenshot_review", """
SELECT screenshot_type, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_bytes,
       min(upload_date) AS oldest_upload,
       CAST(DATE '2024-02-01' - CAST(min(upload_date) AS DATE) AS INTEGER) AS max_age_days,
       CASE WHEN sum(file_size) < 1024 THEN CAST(sum(file_size) AS VARCHAR) || ' Bytes'
            WHEN sum(file_size) < 1048576
              THEN regexp_replace(CAST(round(sum(file_size) / 1024.0, 2) AS VARCHAR), '\\.0$', '') || ' KB'
            WHEN sum(file_size) < 1073741824
              THEN regexp_replace(CAST(round(sum(file_size) / 1048576.0, 2) AS VARCHAR), '\\.0$', '') || ' MB'
            ELSE regexp_replace(CAST(round(sum(file_size) / 1073741824.0, 2) AS VARCHAR), '\\.0$', '') || ' GB'
       END AS total_size
FROM screenshots WHERE verification_status = 'pending' GROUP BY screenshot_type
""")
def q_screenshot_review(spark, sf_dir):
    return R.screenshot_review(Academy(spark, sf_dir).screenshots, "2024-02-01 00:00:00")


@query("student_stats_bucketed", """
SELECT s.id, s.student_id, s.name, coalesce(e.courses, 0) AS courses,
       CAST(coalesce(p.paid, 0) AS DECIMAL(38,2)) AS total_paid,
       CAST(coalesce(p.due, 0) AS DECIMAL(38,2)) AS total_due,
       CASE WHEN e.pn > 0 THEN CAST(e.ps AS DOUBLE) / e.pn END AS mean_progress
FROM students s
LEFT JOIN (SELECT student_id, count(*) AS courses, sum(progress) AS ps, count(progress) AS pn
           FROM enrollments GROUP BY student_id) e ON s.id = e.student_id
LEFT JOIN (SELECT student_id, sum(amount) FILTER (WHERE payment_status = 'paid') AS paid,
                  sum(amount) FILTER (WHERE payment_status <> 'paid') AS due
           FROM payments GROUP BY student_id) p ON s.id = p.student_id
""")
def q_student_stats_bucketed(spark, sf_dir):
    """student_stats over tables bucketed on the student key (written once per source): no exchange before the joins."""
    a = Academy(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = bucketed_once(a.students, "students", "id", buckets)
    e = bucketed_once(a.enrollments, "enrollments", "student_id", buckets)
    p = bucketed_once(a.payments, "payments", "student_id", buckets)
    return R.student_stats(s, e, p)
