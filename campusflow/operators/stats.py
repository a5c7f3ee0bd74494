"""Dashboard figures: one-row aggregates.

Each table is scanned once; payments figures (count, revenue, pending,
overdue, this month) share a single partial aggregate.  The three one-row
results are stacked with ``unionByName`` and summed, so no join of any kind
is planned and only three tiny rows ever cross the final exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.columns import _date_lit
from campusflow.schemas import MONEY_SUM
from campusflow.sources.store import month_filter

_COUNT_COLS = ("total_students", "total_courses", "total_payments")
_MONEY_COLS = ("total_revenue", "pending_fees", "overdue_fees", "monthly_revenue")


def _money_sum(cond_or_col) -> F.Column:
    return F.sum(cond_or_col).cast(MONEY_SUM)


def month_bounds(as_of):
    """(first day of as_of's month, first day of the next month) as DATE columns."""
    start = F.trunc(_date_lit(as_of), "MM")
    return start, F.add_months(start, 1)


def payment_figures(payments: DataFrame, as_of=None) -> DataFrame:
    """count, revenue (all rows), pending, overdue and, with ``as_of``, this month's revenue."""
    amt = F.col("amount")
    aggs = [
        F.count(F.lit(1)).alias("total_payments"),
        _money_sum(amt).alias("total_revenue"),
        _money_sum(F.when(F.col("payment_status") == "pending", amt)).alias("pending_fees"),
        _money_sum(F.when(F.col("payment_status") == "overdue", amt)).alias("overdue_fees"),
    ]
    if as_of is not None:
        lo, hi = month_bounds(as_of)
        in_month = (F.col("payment_date") >= lo) & (F.col("payment_date") < hi)
        aggs.append(_money_sum(F.when(in_month, amt)).alias("monthly_revenue"))
    return payments.agg(*aggs)


def dashboard_stats(students: DataFrame, courses: DataFrame, payments: DataFrame,
                    as_of=None) -> DataFrame:
    """total_students, total_courses, total_payments, total_revenue, pending_fees,
    overdue_fees[, monthly_revenue]; sums over no rows are 0, not NULL."""
    money = [c for c in _MONEY_COLS if as_of is not None or c != "monthly_revenue"]
    zero_n = F.lit(0).cast("bigint")
    zero_m = F.lit(0).cast(MONEY_SUM)

    def shaped(df, present):
        return df.select(*[(F.col(c) if c in present else zero_n).alias(c) for c in _COUNT_COLS],
                         *[(F.col(c) if c in present else zero_m).alias(c) for c in money])

    s = shaped(students.agg(F.count(F.lit(1)).alias("total_students")), {"total_students"})
    c = shaped(courses.agg(F.count(F.lit(1)).alias("total_courses")), {"total_courses"})
    p = shaped(payment_figures(payments, as_of), {"total_payments", *money})
    stacked = s.unionByName(c).unionByName(p)
    return stacked.agg(*[F.sum(x).cast("bigint").alias(x) for x in _COUNT_COLS],
                       *[F.coalesce(F.sum(x), zero_m).cast(MONEY_SUM).alias(x) for x in money])


def pending_fees(payments: DataFrame) -> DataFrame:
    """Money not yet paid: sum of ``pending`` amounts (0 when none)."""
    return payments.agg(F.coalesce(_money_sum(F.when(F.col("payment_status") == "pending",
                                                      F.col("amount"))),
                                   F.lit(0).cast(MONEY_SUM)).alias("pending_fees"))


def monthly_revenue(payments: DataFrame, as_of) -> DataFrame:
    """Revenue of the calendar month containing ``as_of``.  The date range is a plain
    predicate, so it reaches the scan (and prunes partitions when payments are
    stored partitioned by month)."""
    lo, hi = month_bounds(as_of)
    return (month_filter(payments, "payment_date", lo, hi)
            .agg(F.coalesce(_money_sum(F.col("amount")), F.lit(0).cast(MONEY_SUM))
                 .alias("monthly_revenue"),
                 F.count(F.lit(1)).alias("payments_in_month")))
