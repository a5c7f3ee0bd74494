"""Figures kept up to date as rows arrive or change, each by a small state that merges with a batch's own.

* Distinct students and courses: a code index (filters and codes per bucket), so a row that arrives again, in whichever
  micro-batch, counts once; the count is the sum over the index's manifest.
* Sums by month or day: partial sums per month.  A batch's signed sums are merged into the months it touches, and only
  those are written again; later, corrected and withdrawn rows are sums like others.

Every version of a state belongs to a batch of a stream, so a replay makes the same version again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.operators.stats import month_bounds
from campusflow.schemas import MONEY_SUM
from campusflow.session import checkpoint_dir
from campusflow.sources import code_index as Ci
from campusflow.sources import manifest as Mf

_MONTH_ENTRY = "month date, path string, writer string"
#: Columns that are summed: figures of the payments of a month, and of the activity of a day.
PAYMENT_SUMS = {"total_payments": "bigint", "total_revenue": MONEY_SUM, "pending_fees": MONEY_SUM, "overdue_fees": MONEY_SUM}
DAY_SUMS = {"enrollments": "bigint", "payments": "bigint", "revenue": MONEY_SUM}


def _type(t) -> str:
    return t if isinstance(t, str) else t.simpleString()


# ---- sums by month ----------------------------------------------------------------------

def _schema(keys: dict, sums: dict) -> str:
    return ", ".join(f"{c} {_type(t)}" for c, t in {"month": "date", **keys, **sums}.items())


def _months(spark: SparkSession, root: str, entries: list, schema: str) -> DataFrame:
    entries = [e for e in entries if e["path"]]
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{e['path']}" for e in entries])


def _stored(spark: SparkSession, root: str, schema: str) -> DataFrame:
    known = Mf.versions(spark, root)
    return _months(spark, root, Mf.manifest(spark, root, known[-1]).collect() if known else [], schema)


def merge_sums(delta: DataFrame, root: str, keys: dict, sums: dict, name: str) -> None:
    """Add ``delta`` (month, ``keys``, ``sums``) to the sums stored at ``root``: the months in it are read, merged and
    written again, the others stay files of earlier versions.  A row whose sums are all 0 goes."""
    spark, schema = delta.sparkSession, _schema(keys, sums)
    checkpoint_dir(spark)

    def added(df):
        return df.groupBy("month", *keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in sums.items()])

    before, version = Mf.base_of(spark, root, name)
    found = Mf.manifest(spark, root, before).collect() if before is not None else []  # one row per month
    delta = added(delta.filter("month is not null")).checkpoint(eager=True)  # at most the days of the batch
    touched = {r["month"] for r in delta.select("month").distinct().collect()}
    current = _months(spark, root, [e for e in found if e["month"] in touched], schema)
    merged = added(current.unionByName(delta)).filter(" or ".join(f"{c} != 0" for c in sums))
    folder = f"data/{name}"
    merged.withColumn("of", F.col("month")).repartition("of").write.mode("overwrite").partitionBy("of").parquet(f"{root}/{folder}")
    left = spark.read.schema(schema).parquet(f"{root}/{folder}").select("month").distinct().collect()
    entries = [(e["month"], e["path"], name) for e in found if e["month"] not in touched and e["path"]]
    entries += [(r["month"], f"{folder}/of={r['month']}", name) for r in left]
    Mf.commit(spark.createDataFrame(entries or [(None, "", name)], _MONTH_ENTRY), root, version)
    Mf.retire(spark, root, Ci.KEEP)


# ---- daily and monthly statistics -------------------------------------------------------

def signed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows in which two states of a table differ, with ``sign``: -1 as they were, 1 as they are; row by row, so a
    row that repeats counts as often as it does."""
    columns = old.columns
    both = old.select(*columns, F.lit(-1).alias("sign")).unionByName(new.select(*columns, F.lit(1).alias("sign")))
    net = both.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign != 0")
    return net.select(*columns, F.col("sign").cast("bigint").alias("sign"))


def apply_activity(spark: SparkSession, root: str, name: str, enrollments: DataFrame | None = None,
                   payments: DataFrame | None = None) -> None:
    """Merge signed rows into the daily statistics at ``root``: new rows have ``sign`` 1, withdrawn ones -1, a
    corrected row is both.  Needs enrollment_date, or payment_date and amount; rows without a date take no part.
    """
    parts = []
    if enrollments is not None:
        parts.append(enrollments.select(F.col("enrollment_date").alias("day"), F.col("sign").alias("enrollments"),
                                        F.lit(0).alias("payments"), F.lit(0).cast(MONEY_SUM).alias("revenue")))
    if payments is not None:
        amount = F.coalesce(F.col("amount"), F.lit(0).cast("decimal(12,2)"))
        parts.append(payments.select(F.col("payment_date").alias("day"), F.lit(0).cast("bigint").alias("enrollments"),
                                     F.col("sign").alias("payments"), (F.col("sign") * amount).cast(MONEY_SUM).alias("revenue")))
    delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    merge_sums(delta.select(F.trunc("day", "MM").alias("month"), *delta.columns), root, {"day": "date"}, DAY_SUMS, name)


def kept_daily_stats(spark: SparkSession, root: str) -> DataFrame:
    """``daily_stats`` from the stored sums."""
    return _stored(spark, root, _schema({"day": "date"}, DAY_SUMS)).select("day", *DAY_SUMS)


def kept_monthly_summary(spark: SparkSession, root: str) -> DataFrame:
    """``monthly_summary`` from the stored sums: at most 31 rows per month are read."""
    days = _stored(spark, root, _schema({"day": "date"}, DAY_SUMS))
    return days.groupBy("month").agg(*[F.sum(c).cast(t).alias(c) for c, t in DAY_SUMS.items()])


# ---- live dashboard ---------------------------------------------------------------------

def count_batch(batch: DataFrame, root: str, batch_id: int, stream: str = "stream", key: str = "id") -> None:
    """Count the rows of a micro-batch whose ``key`` no earlier batch had; rows without one do not count."""
    spark, name = batch.sparkSession, f"{stream}-{batch_id}"
    checkpoint_dir(spark)
    before, version = Mf.base_of(spark, root, name)
    found = Ci.entries(spark, root, before)
    codes = batch.select(F.col(key).cast("string").alias("code")).filter("code is not null").distinct().checkpoint(eager=True)
    known = Ci.codes_of(spark, root, found, Ci.hit_buckets(spark, root, found, codes, Ci.BUCKETS)).select("code")
    Ci.add_codes(spark, root, found, codes.join(known, "code", "left_anti").withColumn("id", F.lit(0)), version, name)


def payments_batch(batch: DataFrame, root: str, batch_id: int, stream: str = "stream") -> None:
    """Add the figures of a micro-batch of payments to those of their months; payments without a date count in none
    of the months but in the totals."""
    amount, status = F.col("amount"), F.col("payment_status")
    figures = batch.select(
        F.coalesce(F.trunc("payment_date", "MM"), F.lit("0001-01-01").cast("date")).alias("month"),
        F.lit(1).alias("total_payments"), F.coalesce(amount, F.lit(0)).alias("total_revenue"),
        *[F.when(status == s, amount).otherwise(F.lit(0)).alias(f"{s}_fees") for s in ("pending", "overdue")])
    merge_sums(figures, root, {}, PAYMENT_SUMS, f"{stream}-{batch_id}")


def stream_dashboard(students: DataFrame, courses: DataFrame, payments: DataFrame, root: str, checkpoint: str) -> list:
    """Keep all figures of the dashboard up to date from three streams; the queries, which run side by side."""
    def start(rows, part, body):
        name = hashlib.md5(f"{checkpoint}/{part}".encode()).hexdigest()
        return (rows.writeStream.option("checkpointLocation", f"{checkpoint}/{part}")
                .foreachBatch(lambda b, bid: body(b, f"{root}/{part}", bid, name)).trigger(availableNow=True).start())
    return [start(students, "students", count_batch), start(courses, "courses", count_batch),
            start(payments, "payments", payments_batch)]


def _counted(spark: SparkSession, root: str) -> int:
    known = Mf.versions(spark, root)
    return sum(e["n"] for e in Ci.entries(spark, root, known[-1] if known else None) if e["kind"] == "codes")


def live_dashboard(spark: SparkSession, root: str, as_of) -> DataFrame:
    """``dashboard_stats`` as of the last triggers: one row, from the manifests and a row per month."""
    lo, _ = month_bounds(as_of)
    months = _stored(spark, f"{root}/payments", _schema({}, PAYMENT_SUMS))
    zero = {c: F.lit(0).cast(t) for c, t in PAYMENT_SUMS.items()}
    this_month = F.sum(F.when(F.col("month") == lo, F.col("total_revenue")))
    return months.agg(
        *[F.coalesce(F.sum(c), zero[c]).cast(t).alias(c) for c, t in PAYMENT_SUMS.items()],
        F.coalesce(this_month, F.lit(0)).cast(MONEY_SUM).alias("monthly_revenue")).select(
        F.lit(_counted(spark, f"{root}/students")).cast("bigint").alias("total_students"),
        F.lit(_counted(spark, f"{root}/courses")).cast("bigint").alias("total_courses"), "*")
