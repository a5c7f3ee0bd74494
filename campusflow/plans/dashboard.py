"""Registered dashboard queries (stats, fees, revenue)."""

from __future__ import annotations

from campusflow.operators import stats
from campusflow.plans.registry import AS_OF_SALES, query
from campusflow.sources.adapters import Academy
from campusflow.sources.store import stored_once, write_by_month
from campusflow.sources.tables import scan_table


@query("dashboard_stats", f"""
SELECT (SELECT count(*) FROM students) AS total_students,
       (SELECT count(*) FROM courses) AS total_courses,
       count(*) AS total_payments,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_revenue,
       CAST(coalesce(sum(amount) FILTER (WHERE payment_status = 'pending'), 0) AS DECIMAL(38,2))
         AS pending_fees,
       CAST(coalesce(sum(amount) FILTER (WHERE payment_status = 'overdue'), 0) AS DECIMAL(38,2))
         AS overdue_fees,
       CAST(coalesce(sum(amount) FILTER (WHERE date_trunc('month', payment_date)
            = date_trunc('month', DATE '{AS_OF_SALES[:10]}')), 0) AS DECIMAL(38,2)) AS monthly_revenue
FROM payments
""")
def q_dashboard_stats(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return stats.dashboard_stats(a.students, a.courses, a.payments, as_of=AS_OF_SALES)


@query("pending_fees", """
SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS pending_fees
FROM payments WHERE payment_status = 'pending'
""")
def q_pending_fees(spark, sf_dir):
    return stats.pending_fees(Academy(spark, sf_dir).payments)


@query("monthly_revenue", f"""
SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS monthly_revenue,
       count(*) AS payments_in_month
FROM payments
WHERE payment_date >= date_trunc('month', DATE '{AS_OF_SALES[:10]}')
  AND payment_date < date_trunc('month', DATE '{AS_OF_SALES[:10]}') + INTERVAL 1 MONTH
""")
def q_monthly_revenue(spark, sf_dir):
    return stats.monthly_revenue(Academy(spark, sf_dir).payments, AS_OF_SALES)


@query("monthly_revenue_pruned", f"""
SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS monthly_revenue,
       count(*) AS payments_in_month
FROM payments
WHERE payment_date >= date_trunc('month', DATE '{AS_OF_SALES[:10]}')
  AND payment_date < date_trunc('month', DATE '{AS_OF_SALES[:10]}') + INTERVAL 1 MONTH
""")
def q_monthly_revenue_pruned(spark, sf_dir):
    """Monthly revenue over payments stored partitioned by month (written once per source): one directory is read."""
    payments = Academy(spark, sf_dir).payments
    path = stored_once(payments, "payments-by-month", lambda p: write_by_month(payments, p, "payment_date"))
    return stats.monthly_revenue(scan_table(spark, path), AS_OF_SALES)
