"""Registered time-series, distribution and grouping queries."""

from __future__ import annotations

from campusflow.operators import series as Sr
from campusflow.operators.changes import number_rows
from campusflow.plans.registry import AS_OF_SALES, query
from campusflow.sources.adapters import Academy

_D = AS_OF_SALES[:10]


@query("revenue_by_month", """
SELECT CAST(date_trunc('month', payment_date) AS DATE) AS month,
       strftime(date_trunc('month', payment_date), '%Y-%m') AS label,
       count(*) AS payments, CAST(sum(amount) AS DECIMAL(38,2)) AS revenue
FROM payments GROUP BY 1, 2
""")
def q_revenue_by_month(spark, sf_dir):
    return Sr.revenue_by_month(Academy(spark, sf_dir).payments)


def _by_month_sql(period):
    return f"""
WITH spine AS (
  SELECT CAST(m AS DATE) AS month FROM generate_series(
    CAST(date_trunc('month', DATE '{_D}') - INTERVAL {period - 1} MONTH AS DATE),
    CAST(date_trunc('month', DATE '{_D}') AS DATE), INTERVAL 1 MONTH) t(m)),
c AS (SELECT CAST(date_trunc('month', enrollment_date) AS DATE) AS m, count(*) AS n FROM enrollments
      GROUP BY 1)
SELECT spine.month, strftime(spine.month, '%Y-%m') AS label, coalesce(c.n, 0) AS enrollments
FROM spine LEFT JOIN c ON spine.month = c.m
"""


for _p in (6, 12, 24):
    def _mk(period):
        @query(f"enrollments_by_month_{period}", _by_month_sql(period))
        def q(spark, sf_dir):
            return Sr.enrollments_by_month(Academy(spark, sf_dir).enrollments, AS_OF_SALES, period)
        return q
    _mk(_p)


@query("enrollment_distribution", """
WITH counts AS (SELECT course_id, count(*) AS n FROM enrollments GROUP BY course_id),
ranked AS (SELECT course_id, n, row_number() OVER (ORDER BY n DESC, course_id NULLS LAST) AS r FROM counts),
g AS (SELECT CASE WHEN r <= 4 THEN r ELSE 5 END AS rank,
             max(CASE WHEN r <= 4 THEN course_id END) AS course_id, sum(n) AS enrollments
      FROM ranked GROUP BY 1)
SELECT g.rank, g.course_id,
       CASE WHEN g.rank > 4 THEN 'Other' ELSE coalesce(nullif(c.course_name, ''), 'N/A') END AS label,
       CAST(g.enrollments AS BIGINT) AS enrollments,
       CAST(g.enrollments AS DOUBLE) / CAST(sum(g.enrollments) OVER () AS DOUBLE) AS share
FROM g LEFT JOIN courses c ON g.course_id = c.id
""")
def q_enrollment_distribution(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return Sr.enrollment_distribution(a.enrollments, a.courses, top=4)


@query("group_rows", """
SELECT id, payment_status, payment_date, count(*) OVER (PARTITION BY payment_status) AS group_size,
       row_number() OVER (ORDER BY payment_status, payment_date, id) AS position
FROM payments
""")
def q_group_rows(spark, sf_dir):
    p = Academy(spark, sf_dir).payments.select("id", "payment_status", "payment_date")
    return number_rows(Sr.group_rows(p, "payment_status", ["payment_date", "id"]))


@query("unique_rows", """
SELECT student_id, course_id, id, enrollment_date, status, progress FROM (
  SELECT *, row_number() OVER (PARTITION BY student_id, course_id
                               ORDER BY enrollment_date, id, status, progress) AS rn
  FROM (SELECT student_id, course_id, id, enrollment_date, status, progress FROM enrollments))
WHERE rn = 1
""")
def q_unique_rows(spark, sf_dir):
    """First enrollment of each (student, course) pair."""
    e = Academy(spark, sf_dir).enrollments.select("student_id", "course_id", "id", "enrollment_date",
                                                   "status", "progress")
    return Sr.unique_rows(e, ["student_id", "course_id"], ["enrollment_date", "id", "status", "progress"])


@query("payment_summary", """
SELECT payment_status, payment_method, count(*) AS payments,
       CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS mean_amount
FROM payments GROUP BY 1, 2
""")
def q_payment_summary(spark, sf_dir):
    return Sr.payment_summary(Academy(spark, sf_dir).payments)
