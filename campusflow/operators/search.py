"""Search, filters and sorts over listings.

All predicates are plain column expressions, so Catalyst pushes the
comparable ones (status, date range, id) into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.functions import columns as C


def search_rows(df: DataFrame, term: str, cols=None) -> DataFrame:
    """Case-insensitive literal substring match over the text of the given cells.

    Cells are joined with a newline, so a match cannot span two cells; ``%``
    and ``_`` in ``term`` are data, not wildcards.  An empty term keeps all rows.
    """
    if not term:
        return df
    return df.filter(search_text(cols or df.columns).contains(F.lit(term.lower())))


def search_text(cols) -> Column:
    """What a search looks into: the cells' text in lower case."""
    return F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in cols]))


def search_students(listing: DataFrame, term: str) -> DataFrame:
    return search_rows(listing, term, ["student_id", "name", "email", "phone", "course_name",
                                       "admission_date", "status"])


def search_courses(listing: DataFrame, term: str) -> DataFrame:
    return search_rows(listing, term, ["course_code", "course_name", "instructor", "duration_weeks",
                                       "price", "enrolled_students", "status"])


def search_payments(listing: DataFrame, term: str) -> DataFrame:
    return search_rows(listing, term, ["student_name", "course_name", "amount", "payment_date",
                                       "payment_method", "payment_status", "reference_number"])


def filter_students(df: DataFrame, course_id: int = 0, status: str = "") -> DataFrame:
    """Optional course (0 = any) and status ('' = any); absent conjuncts are not planned."""
    if course_id:
        df = df.filter(F.col("course_id") == F.lit(course_id))
    if status:
        df = df.filter(F.col("status") == F.lit(status))
    return df


def filter_payments(df: DataFrame, status: str = "", date_from=None) -> DataFrame:
    if status:
        df = df.filter(F.col("payment_status") == F.lit(status))
    if date_from:
        day = C._date_lit(date_from)
        df = df.filter(F.col("payment_date") >= day)
        if "payment_month" in df.columns:  # month-partitioned storage: prune directories too
            df = df.filter(F.col("payment_month") >= F.trunc(day, "MM"))
    return df


def sort_rows(df: DataFrame, key: str, direction: str = "asc", tiebreak: str = "id") -> DataFrame:
    """Sort on one key; Spark's sort is not stable, so a tie-break column is required."""
    k, t = F.col(key), F.col(tiebreak)
    if direction == "desc":
        return df.orderBy(k.desc_nulls_last(), t.desc())
    return df.orderBy(k.asc_nulls_last(), t.asc())


def sort_mixed(df: DataFrame, col: str, direction: str = "asc", tiebreak: str = "id") -> DataFrame:
    """Numbers (as read from display text) first, numerically; then the rest as text.

    Meant for STRING columns: ``2024-01-15`` reads as 2024.
    """
    key = C.mixed_sort_key(col)
    if direction == "desc":
        return df.orderBy(key.desc_nulls_first(), F.col(col).desc_nulls_last(), F.col(tiebreak).desc())
    return df.orderBy(key.asc_nulls_last(), F.col(col).asc_nulls_last(), F.col(tiebreak).asc())
