"""Joined listings, paging and top-k views.

Join strategy is left to Catalyst/AQE: dimension sides (courses, students)
grow with the data, so nothing is hinted; AQE turns a join into a broadcast
only when the measured shuffle size is under ``autoBroadcastJoinThreshold``.
The one explicit ``broadcast`` is of the keys of a top-k result, bounded by ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.operators.layout import materialize

STUDENT_LIST_COLS = ["id", "student_id", "name", "email", "phone", "course_name",
                     "admission_date", "status"]
COURSE_LIST_COLS = ["id", "course_code", "course_name", "instructor", "duration_weeks", "price",
                    "enrolled_students", "status"]
PAYMENT_LIST_COLS = ["id", "student_name", "course_name", "amount", "payment_date",
                     "payment_method", "payment_status", "reference_number"]


def select_columns(df: DataFrame, cols) -> DataFrame:
    """The fixed column list of a listing (Catalyst prunes everything else from the scans)."""
    return df.select(*cols)


def _names(courses: DataFrame) -> DataFrame:
    return courses.select(F.col("id").alias("_course_key"), F.col("course_name").alias("_course_name"))


def _spread(key: str) -> Column:
    """A second join key: rows without ``key`` match nothing and are spread by their id over all partitions."""
    return F.when(F.col(key).isNull(), F.col("id")).otherwise(F.lit(0).cast("bigint"))


def students_with_course(students: DataFrame, courses: DataFrame) -> DataFrame:
    """Students plus ``course_name`` ('N/A' when the course is missing).

    Students without a course match nothing; a second join key spreads them over
    all partitions instead of hashing every NULL to the same one.
    """
    c = _names(courses).withColumn("_one", F.lit(0).cast("bigint"))
    s = students.withColumn("_spread", _spread("course_id"))
    j = s.join(c, (s.course_id == c._course_key) & (s._spread == c._one), "left")
    return j.select(*[x for x in students.columns],
                    C.default_value("_course_name", C.NOT_AVAILABLE).alias("course_name"))


def payments_with_names(payments: DataFrame, students: DataFrame, courses: DataFrame) -> DataFrame:
    """Payments plus student and course names; those without a student or course are spread as above."""
    zero = F.lit(0).cast("bigint")
    s = students.select(F.col("id").alias("_student_key"), F.col("name").alias("_student_name"), zero.alias("_one"))
    c = _names(courses).withColumn("_naught", zero)
    p = payments.withColumns({"_s": _spread("student_id"), "_c": _spread("course_id")})
    j = (p.join(s, (p.student_id == s._student_key) & (p._s == s._one), "left")
         .join(c, (p.course_id == c._course_key) & (p._c == c._naught), "left"))
    return j.select(*payments.columns,
                    C.default_value("_student_name", C.NOT_AVAILABLE).alias("student_name"),
                    C.default_value("_course_name", C.NOT_AVAILABLE).alias("course_name"),
                    C.default_value("reference_number", C.NOT_AVAILABLE).alias("reference_display"))


def enrollment_counts(enrollments: DataFrame) -> DataFrame:
    """Enrollments per course; partial aggregation absorbs hot courses map-side."""
    return enrollments.groupBy(F.col("course_id").alias("_course_key")).agg(
        F.count(F.lit(1)).alias("_n"))


def courses_with_enrollment_count(courses: DataFrame, enrollments: DataFrame) -> DataFrame:
    n = enrollment_counts(enrollments)
    j = courses.join(n, courses.id == n._course_key, "left")
    return j.select(*courses.columns, F.coalesce("_n", F.lit(0).cast("bigint")).alias("enrolled_students"))


def list_students(students: DataFrame, courses: DataFrame) -> DataFrame:
    """Students listing, newest first (``created_at`` DESC, NULLs last, then id)."""
    return (select_columns(students_with_course(students, courses), STUDENT_LIST_COLS + ["created_at"])
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()))


def list_courses(courses: DataFrame, enrollments: DataFrame) -> DataFrame:
    listing = courses_with_enrollment_count(courses, enrollments)
    return (select_columns(listing, COURSE_LIST_COLS + ["created_at"])
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()))


def list_payments(payments: DataFrame, students: DataFrame, courses: DataFrame) -> DataFrame:
    return (select_columns(payments_with_names(payments, students, courses), PAYMENT_LIST_COLS)
            .orderBy(F.col("payment_date").desc_nulls_last(), F.col("id").desc()))


def page_rows(df: DataFrame, order_by, page: int = 1, per_page: int = 20) -> DataFrame:
    """Page ``page`` (1-based) of ``per_page`` rows in ``order_by`` order, with ``row_no``.

    ``orderBy + offset + limit`` plans as one ``TakeOrderedAndProject``: each
    partition keeps its best ``page * per_page`` rows.  For deep pages use
    :func:`page_after` (keyset paging), whose cost does not grow with the page.
    """
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    skip = (page - 1) * per_page
    top = df.orderBy(*order_by).offset(skip).limit(per_page) if skip else \
        df.orderBy(*order_by).limit(per_page)
    # numbering the <= per_page rows left; the unpartitioned window is bounded by per_page
    return top.withColumn("row_no", (F.row_number().over(Window.orderBy(*order_by)) + F.lit(skip))
                          .cast("bigint"))


def page_after(df: DataFrame, key: str, tiebreak: str, last_key, last_tiebreak,
               per_page: int = 20, descending: bool = True) -> DataFrame:
    """Keyset page: the ``per_page`` rows after (last_key, last_tiebreak)."""
    k, t = F.col(key), F.col(tiebreak)
    if descending:
        cond = (k < F.lit(last_key)) | ((k == F.lit(last_key)) & (t < F.lit(last_tiebreak)))
        order = [k.desc(), t.desc()]
    else:
        cond = (k > F.lit(last_key)) | ((k == F.lit(last_key)) & (t > F.lit(last_tiebreak)))
        order = [k.asc(), t.asc()]
    return df.filter(cond).orderBy(*order).limit(per_page)


def _semi_lookup(big: DataFrame, big_key: str, small_keys: DataFrame) -> DataFrame:
    """Rows of ``big`` whose key is among ``small_keys`` (a top-k result of bounded size).

    The broadcast side is bounded by the caller's ``n``; ``big`` is streamed
    through a broadcast hash semi join, no shuffle.
    """
    return big.join(F.broadcast(small_keys), big[big_key] == small_keys["_k"], "left_semi")


def recent_admissions(enrollments: DataFrame, students: DataFrame, courses: DataFrame,
                      n: int = 5) -> DataFrame:
    """Newest ``n`` enrollments with student name/email and course name.

    The top-``n`` is cut first (one ``TakeOrderedAndProject`` over enrollments)
    and materialised once, then only the matching students and courses are
    fetched.  An enrollment whose student is missing shows 'N/A' instead of
    vanishing.
    """
    order = [F.col("enrollment_date").desc_nulls_last(), F.col("id").desc(), F.col("course_id").asc()]
    # the cut needs no student: where a source joins the student in, that join stays out of it
    cut = materialize(enrollments.select("id", "course_id", "enrollment_date", "status").orderBy(*order).limit(n))
    wanted = cut.select(F.col("id").alias("_k")).distinct()
    owners = materialize(_semi_lookup(enrollments.select("id", "student_id"), "id", wanted)
                         .groupBy(F.col("id").alias("_eid")).agg(F.min("student_id").alias("student_id")))
    top = cut.join(owners, cut["id"] == owners["_eid"], "left").drop("_eid")
    s = _semi_lookup(students.select("id", "name", "email"), "id",
                     top.select(F.col("student_id").alias("_k")).distinct())
    s = s.select(F.col("id").alias("_sid"), "name", "email")
    c = _semi_lookup(courses.select("id", "course_name"), "id",
                     top.select(F.col("course_id").alias("_k")).distinct())
    c = c.select(F.col("id").alias("_cid"), "course_name")
    j = (top.join(s, top.student_id == s._sid, "left").join(c, top.course_id == c._cid, "left"))
    return j.select(
        # numbering the <= n rows left; the unpartitioned window is bounded by n
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("row_no"),
        F.col("id").alias("enrollment_id"),
        C.default_value("name", C.NOT_AVAILABLE).alias("student_name"),
        C.default_value("email", C.NOT_AVAILABLE).alias("email"),
        C.default_value("course_name", C.NOT_AVAILABLE).alias("course_name"),
        C.format_date_short("enrollment_date").alias("enrollment_date"),
        C.status_label("status").alias("status"),
    )


def upcoming_courses(courses: DataFrame, as_of, n: int = 5) -> DataFrame:
    """Next ``n`` courses starting on or after the date of ``as_of``, with a start bucket."""
    day = C._date_lit(as_of)
    order = [F.col("start_date").asc(), F.col("id").asc()]
    top = (courses.select("id", "course_name", "description", "start_date")
           .filter(F.col("start_date") >= day).orderBy(*order).limit(n))
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("row_no"),
        "id", "course_name",
        C.default_value("description", C.NO_DESCRIPTION).alias("description"),
        C.format_date_short("start_date").alias("start_date"),
        C.days_until("start_date", as_of).alias("days_until"),
        C.course_start_bucket("start_date", as_of).alias("start_status"),
    )


def lookup_by_id(df: DataFrame, id_value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(id_value))


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (an anti join; the caller writes the result)."""
    ik = ids_key or key
    victims = ids.select(F.col(ik).alias("_victim")).distinct()
    return df.join(victims, df[key] == victims._victim, "left_anti")


# relationship -> (child column, parent table)
ORPHAN_RELATIONSHIPS = {
    "payments.student_id": ("payments", "student_id", "students"),
    "payments.course_id": ("payments", "course_id", "courses"),
    "enrollments.student_id": ("enrollments", "student_id", "students"),
    "enrollments.course_id": ("enrollments", "course_id", "courses"),
    "students.course_id": ("students", "course_id", "courses"),
}


def orphan_check(payments: DataFrame, enrollments: DataFrame, students: DataFrame,
                 courses: DataFrame) -> DataFrame:
    """Rows per relationship whose parent is missing: (relationship, orphans).

    Per relationship the child table is reduced to one row per key (column
    pruned, a hot key is one row) before the anti join with its parents.  NULL
    keys are not orphans; every relationship appears, with 0 when clean.
    """
    tables = {"payments": payments, "enrollments": enrollments, "students": students, "courses": courses}

    found = None
    for rel, (child, col, parent) in ORPHAN_RELATIONSHIPS.items():
        keys = (tables[child].filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("fk"))
                .agg(F.count(F.lit(1)).alias("_n")))
        ids = tables[parent].select(F.col("id").alias("pk"))
        part = (keys.join(ids, keys.fk == ids.pk, "left_anti")
                .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n")).select(F.lit(rel).alias("rel"), "_n"))
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("rel").alias("relationship"), F.col("_n").cast("bigint").alias("orphans"))
