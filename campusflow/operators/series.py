"""Monthly series, distributions and generic grouping.

Every aggregate here is algebraic (count / sum / min_by), so Spark
pre-aggregates map-side and a hot key costs one partial row per map task.
Nothing collects a group into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.operators.layout import materialize
from campusflow.schemas import MONEY_SUM


def revenue_by_month(payments: DataFrame) -> DataFrame:
    """(month DATE, label yyyy-MM, payments, revenue) per calendar month with payments."""
    m = F.trunc("payment_date", "MM")
    return (payments.groupBy(m.alias("month"))
            .agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").cast(MONEY_SUM).alias("revenue"))
            .select("month", F.date_format("month", "yyyy-MM").alias("label"), "payments", "revenue"))


def month_spine(anchor: DataFrame, as_of, period: int) -> DataFrame:
    """``period`` month starts ending at the month of ``as_of`` (one row per month).

    Built from a single aggregate row of ``anchor`` (pass a small frame, such as
    the monthly counts, so no large table is scanned for it); its size is
    ``period`` by construction.
    """
    end = F.trunc(C._date_lit(as_of), "MM")
    start = F.add_months(end, -(period - 1))
    one = anchor.agg(F.count(F.lit(1)).alias("_n"))
    return one.select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("month"))


def enrollments_by_month(enrollments: DataFrame, as_of, period: int = 12) -> DataFrame:
    """Enrollments per month over the last ``period`` months (6, 12 or 24), zero-filled."""
    if period < 1:
        raise ValueError("period must be positive")
    end = F.trunc(C._date_lit(as_of), "MM")
    start = F.add_months(end, -(period - 1))
    # read twice (calendar anchor and join): cached, so the enrollments are scanned once
    counts = materialize(enrollments
                         .filter((F.col("enrollment_date") >= start)
                                 & (F.col("enrollment_date") < F.add_months(end, 1)))
                         .groupBy(F.trunc("enrollment_date", "MM").alias("_m"))
                         .agg(F.count(F.lit(1)).alias("_n")))
    spine = month_spine(counts, as_of, period)
    # both sides hold at most ``period`` rows
    j = spine.join(F.broadcast(counts), spine.month == counts._m, "left")
    return j.select("month", F.date_format("month", "yyyy-MM").alias("label"),
                    F.coalesce("_n", F.lit(0).cast("bigint")).alias("enrollments"))


def enrollment_distribution(enrollments: DataFrame, courses: DataFrame, top: int = 4) -> DataFrame:
    """Share of enrollments per course: the ``top`` courses by count, the rest as 'Other'.

    Counts per course (partial agg, materialised once: both the top-k and the
    relabelling read them) -> top-k via TakeOrderedAndProject -> the k winners
    (bounded by ``top``) are broadcast back onto the counts.
    """
    counts = materialize(enrollments.groupBy("course_id").agg(F.count(F.lit(1)).alias("n")))
    winners = (counts.orderBy(F.col("n").desc(), F.col("course_id").asc_nulls_last()).limit(top)
               .select(F.col("course_id").alias("_w"), F.col("n").alias("_wn")))
    ranked = winners.select("_w", F.row_number().over(
        Window.orderBy(F.col("_wn").desc(), F.col("_w").asc_nulls_last())).alias("_rank"))
    tagged = counts.join(F.broadcast(ranked), counts.course_id.eqNullSafe(ranked._w), "left")
    grouped = (tagged.groupBy(F.coalesce("_rank", F.lit(top + 1)).cast("bigint").alias("rank"))
               .agg(F.max(F.when(F.col("_rank").isNotNull(), F.col("course_id"))).alias("course_id"),
                    F.sum("n").alias("enrollments")))
    names = courses.select(F.col("id").alias("_cid"), "course_name")
    named = grouped.join(names, grouped.course_id == names._cid, "left")
    total = F.sum("enrollments").over(Window.partitionBy())  # <= top + 1 rows
    return named.select(
        "rank", "course_id",
        F.when(F.col("rank") > top, F.lit("Other"))
         .otherwise(C.default_value("course_name", C.NOT_AVAILABLE)).alias("label"),
        "enrollments",
        (F.col("enrollments").cast("double") / total.cast("double")).alias("share"))


def group_rows(df: DataFrame, key: str, order_by, num_partitions: int | None = None) -> DataFrame:
    """Rows laid out group by group: each row carries ``group_size`` and its group's rows
    are contiguous and ordered by ``order_by``.

    Range partitioning on (key, order_by) lets one hot group span several
    partitions; no group is ever gathered into one task or one array.  The
    sizes come from a partial aggregate joined back on the key (``df`` is read
    twice; AQE splits a hot key's side of that join).
    """
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    sizes = df.groupBy(F.col(key).alias("_gk")).agg(F.count(F.lit(1)).alias("group_size"))
    j = df.join(sizes, df[key].eqNullSafe(sizes._gk), "left").drop("_gk")
    parts = [num_partitions] if num_partitions else []
    return (j.repartitionByRange(*parts, F.col(key), *[F.col(c) for c in order_cols])
            .sortWithinPartitions(key, *order_cols))


def unique_rows(df: DataFrame, keys, order_by) -> DataFrame:
    """One row per ``keys``: the first by ``order_by`` (``dropDuplicates`` keeps an arbitrary one).

    ``row_number() = 1`` plans a ``WindowGroupLimit`` before the shuffle, so a
    hot key ships one row per map task and each side sorts once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = [c for c in df.columns if c not in keys]
    first = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).select(*keys, *rest)


def payment_summary(payments: DataFrame) -> DataFrame:
    """Count, sum and mean amount per (payment_status, payment_method)."""
    return (payments.groupBy("payment_status", "payment_method")
            .agg(F.count(F.lit(1)).alias("payments"),
                 F.sum("amount").cast(MONEY_SUM).alias("total_amount"),
                 (F.sum("amount").cast("double") / F.count("amount")).alias("mean_amount")))
