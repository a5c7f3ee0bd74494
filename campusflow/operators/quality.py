"""Row validation with quarantine.

``validate_rows`` adds ``errors`` (ARRAY<STRING>) and ``is_valid``; good and
bad rows are then two filters over the same frame.  In a stream the split
happens inside ``foreachBatch`` (see ``campusflow.streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions.columns import validation_errors


def validate_rows(df: DataFrame, required=(), email=(), phone=()) -> DataFrame:
    errs = validation_errors(required=required, email=email, phone=phone)
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the check columns, rejected rows with their errors).

    Both come from one plan; a caller writing both should persist ``validated``
    first (or write it once and read it back) so the source is read once.
    """
    good = validated.filter(F.col("is_valid")).drop("errors", "is_valid")
    bad = validated.filter(~F.col("is_valid"))
    return good, bad


def quality_report(validated: DataFrame) -> DataFrame:
    """Failures per rule: (error, failures)."""
    return (validated.select(F.explode("errors").alias("error"))
            .groupBy("error").agg(F.count(F.lit(1)).alias("failures")))
