"""Registered listing, search, filter, paging and top-k queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.operators import listings as Lst
from campusflow.operators import search as S
from campusflow.operators.changes import number_rows
from campusflow.plans.registry import AS_OF_COURSES, query
from campusflow.session import checkpoint_dir
from campusflow.sources import ranked as Rk
from campusflow.sources import trigrams as Tg
from campusflow.sources.adapters import Academy

_STUDENT_LISTING_SQL = """
SELECT s.id, s.student_id, s.name, s.email, s.phone,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       s.admission_date, s.status, s.created_at
FROM students s LEFT JOIN courses c ON s.course_id = c.id
"""


@query("students_with_course", """
SELECT s.*, coalesce(nullif(c.course_name, ''), 'N/A') AS course_name
FROM students s LEFT JOIN courses c ON s.course_id = c.id
""")
def q_students_with_course(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return Lst.students_with_course(a.students, a.courses)


@query("list_students", f"""
SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS position
FROM ({_STUDENT_LISTING_SQL})
""")
def q_list_students(spark, sf_dir):
    """The students listing, newest first; ``position`` is where each row lies."""
    a = Academy(spark, sf_dir)
    return number_rows(Lst.list_students(a.students, a.courses))


@query("payments_with_names", """
SELECT p.id, coalesce(nullif(s.name, ''), 'N/A') AS student_name,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       p.amount, p.payment_date, p.payment_method, p.payment_status,
       coalesce(nullif(p.reference_number, ''), 'N/A') AS reference_number
FROM payments p LEFT JOIN students s ON p.student_id = s.id LEFT JOIN courses c ON p.course_id = c.id
""")
def q_payments_with_names(spark, sf_dir):
    a = Academy(spark, sf_dir)
    df = Lst.payments_with_names(a.payments, a.students, a.courses)
    return df.select("id", "student_name", "course_name", "amount", "payment_date", "payment_method",
                     "payment_status", F.col("reference_display").alias("reference_number"))


@query("courses_with_enrollment_count", """
SELECT c.*, coalesce(n.n, 0) AS enrolled_students
FROM courses c LEFT JOIN (SELECT course_id, count(*) AS n FROM enrollments GROUP BY course_id) n
  ON c.id = n.course_id
""")
def q_courses_with_enrollment_count(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return Lst.courses_with_enrollment_count(a.courses, a.enrollments)


@query("list_courses", """
SELECT c.id, c.course_code, c.course_name, c.instructor, c.duration_weeks, c.price,
       coalesce(n.n, 0) AS enrolled_students, c.status, c.created_at,
       row_number() OVER (ORDER BY c.created_at DESC NULLS LAST, c.id DESC) AS position
FROM courses c LEFT JOIN (SELECT course_id, count(*) AS n FROM enrollments GROUP BY course_id) n
  ON c.id = n.course_id
""")
def q_list_courses(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return number_rows(Lst.list_courses(a.courses, a.enrollments))


@query("list_payments", """
SELECT p.id, coalesce(nullif(s.name, ''), 'N/A') AS student_name,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       p.amount, p.payment_date, p.payment_method, p.payment_status, p.reference_number,
       row_number() OVER (ORDER BY p.payment_date DESC NULLS LAST, p.id DESC) AS position
FROM payments p LEFT JOIN students s ON p.student_id = s.id LEFT JOIN courses c ON p.course_id = c.id
""")
def q_list_payments(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return number_rows(Lst.list_payments(a.payments, a.students, a.courses))


@query("students_page", f"""
SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS row_no
FROM ({_STUDENT_LISTING_SQL})
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20
""")
def q_students_page(spark, sf_dir):
    """Page 2 of the students listing, 20 rows per page."""
    a = Academy(spark, sf_dir)
    listing = Lst.students_with_course(a.students, a.courses).select(*Lst.STUDENT_LIST_COLS, "created_at")
    return Lst.page_rows(listing, [F.col("created_at").desc_nulls_last(), F.col("id").desc()],
                         page=2, per_page=20)


@query("payments_page_keyset", """
SELECT id, amount, payment_date, payment_status FROM payments
WHERE payment_date < DATE '2000-01-01' OR (payment_date = DATE '2000-01-01' AND id < 0)
ORDER BY payment_date DESC, id DESC LIMIT 25
""")
def q_payments_page_keyset(spark, sf_dir):
    """Keyset page: 25 payments after the cursor (2000-01-01, id 0), newest first."""
    p = Academy(spark, sf_dir).payments.select("id", "amount", "payment_date", "payment_status")
    return Lst.page_after(p, "payment_date", "id", "2000-01-01", 0, per_page=25)


@query("payments_page_deep", """
SELECT * FROM (SELECT id, amount, payment_date, payment_status,
                      row_number() OVER (ORDER BY payment_date DESC NULLS LAST, id) AS row_no FROM payments)
WHERE row_no > 24975 AND row_no <= 25000 OR row_no > 12475 AND row_no <= 12500
""")
def q_payments_page_deep(spark, sf_dir):
    """Pages 1000 and 500 of the payments, 25 rows each, by their numbers: each from the files that hold it."""
    p = Academy(spark, sf_dir).payments.select("id", "amount", "payment_date", "payment_status")
    root = f"{checkpoint_dir(spark).rstrip('/')}/payments-ranked-{uuid.uuid4().hex}"
    Rk.write_ranked(p, root, "-payment_date,id")
    return Rk.ranked_page(spark, root, 1000, 25).unionByName(Rk.ranked_page(spark, root, 500, 25))


@query("search_payments_indexed", """
SELECT p.id, coalesce(nullif(s.name, ''), 'N/A') AS student_name, p.amount, p.reference_number
FROM payments p LEFT JOIN students s ON p.student_id = s.id
WHERE contains(lower(concat_ws(chr(10), coalesce(nullif(s.name, ''), 'N/A'), CAST(p.amount AS VARCHAR), p.reference_number)),
               'ref123')
""")
def q_search_payments_indexed(spark, sf_dir):
    """Payments by a reference number's begin, through an index of trigrams."""
    a = Academy(spark, sf_dir)
    listing = Lst.payments_with_names(a.payments, a.students, a.courses).select("id", "student_name", "amount", "reference_number")
    root = f"{checkpoint_dir(spark).rstrip('/')}/payments-grams-{uuid.uuid4().hex}"
    Tg.write_indexed(listing, root, ["student_name", "amount", "reference_number"])
    return Tg.search_indexed(spark, root, "REF123")


@query("search_documents_indexed", """
SELECT doc_id, n_chars FROM documents WHERE contains(lower(concat_ws(chr(10), text, source)), 'token = ')
""")
def q_search_documents_indexed(spark, sf_dir):
    """Whole documents that contain a term, through an index of trigrams."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/documents-grams-{uuid.uuid4().hex}"
    docs = Academy(spark, sf_dir).raw("documents").select("doc_id", "text", "source", "n_chars")
    Tg.write_indexed(docs, root, ["text", "source"])
    return Tg.search_indexed(spark, root, "Token = ").select("doc_id", "n_chars")


@query("recent_admissions", """
WITH top AS (
  SELECT id, student_id, course_id, enrollment_date, status FROM enrollments
  ORDER BY enrollment_date DESC NULLS LAST, id DESC, student_id, course_id LIMIT 5)
SELECT row_number() OVER (ORDER BY t.enrollment_date DESC NULLS LAST, t.id DESC, t.student_id, t.course_id)
         AS row_no,
       t.id AS enrollment_id,
       coalesce(nullif(s.name, ''), 'N/A') AS student_name,
       coalesce(nullif(s.email, ''), 'N/A') AS email,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       coalesce(strftime(t.enrollment_date, '%b %-d, %Y'), 'N/A') AS enrollment_date,
       CASE WHEN t.status = 'active' THEN 'Active' ELSE 'Inactive' END AS status
FROM top t LEFT JOIN students s ON t.student_id = s.id LEFT JOIN courses c ON t.course_id = c.id
""")
def q_recent_admissions(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return Lst.recent_admissions(a.enrollments, a.students, a.courses, n=5)


@query("upcoming_courses", f"""
WITH top AS (
  SELECT id, course_name, description, start_date FROM courses
  WHERE start_date >= DATE '{AS_OF_COURSES[:10]}' ORDER BY start_date, id LIMIT 5),
d AS (
  SELECT *, CAST(ceil((epoch_ms(CAST(start_date AS TIMESTAMP))
                      - epoch_ms(TIMESTAMP '{AS_OF_COURSES}')) / 86400000.0) AS INTEGER) AS days_until
  FROM top)
SELECT row_number() OVER (ORDER BY start_date, id) AS row_no, id, course_name,
       coalesce(nullif(description, ''), 'No description available') AS description,
       strftime(start_date, '%b %-d, %Y') AS start_date, days_until,
       CASE WHEN days_until > 7 THEN 'Upcoming' WHEN days_until > 0 THEN 'Starting Soon'
            ELSE 'Started' END AS start_status
FROM d
""")
def q_upcoming_courses(spark, sf_dir):
    return Lst.upcoming_courses(Academy(spark, sf_dir).courses, AS_OF_COURSES, n=5)


@query("course_start_buckets", f"""
SELECT start_status, count(*) AS courses FROM (
  SELECT CASE WHEN d > 7 THEN 'Upcoming' WHEN d > 0 THEN 'Starting Soon' ELSE 'Started' END AS start_status
  FROM (SELECT CAST(ceil((epoch_ms(CAST(start_date AS TIMESTAMP))
                         - epoch_ms(TIMESTAMP '{AS_OF_COURSES}')) / 86400000.0) AS INTEGER) AS d
        FROM courses))
GROUP BY start_status
""")
def q_course_start_buckets(spark, sf_dir):
    c = Academy(spark, sf_dir).courses
    return (c.groupBy(C.course_start_bucket("start_date", AS_OF_COURSES).alias("start_status"))
            .agg(F.count(F.lit(1)).alias("courses")))


@query("search_students", f"""
SELECT id, student_id, name, email, phone, course_name, admission_date, status
FROM ({_STUDENT_LISTING_SQL})
WHERE contains(lower(concat_ws(chr(10), student_id, name, email, phone, course_name,
                               CAST(admission_date AS VARCHAR), status)), 'ring')
""")
def q_search_students(spark, sf_dir):
    a = Academy(spark, sf_dir)
    listing = Lst.students_with_course(a.students, a.courses).select(*Lst.STUDENT_LIST_COLS)
    return S.search_students(listing, "RING")


@query("search_courses", """
SELECT c.id, c.course_code, c.course_name, c.instructor, c.duration_weeks, c.price,
       coalesce(n.n, 0) AS enrolled_students, c.status
FROM courses c LEFT JOIN (SELECT course_id, count(*) AS n FROM enrollments GROUP BY course_id) n
  ON c.id = n.course_id
WHERE contains(lower(concat_ws(chr(10), c.course_code, c.course_name, c.instructor,
                               CAST(c.duration_weeks AS VARCHAR), CAST(c.price AS VARCHAR),
                               CAST(coalesce(n.n, 0) AS VARCHAR), c.status)), 'brand#1')
""")
def q_search_courses(spark, sf_dir):
    a = Academy(spark, sf_dir)
    listing = Lst.courses_with_enrollment_count(a.courses, a.enrollments).select(*Lst.COURSE_LIST_COLS)
    return S.search_courses(listing, "Brand#1")


@query("search_payments", """
SELECT p.id, coalesce(nullif(s.name, ''), 'N/A') AS student_name,
       coalesce(nullif(c.course_name, ''), 'N/A') AS course_name,
       p.amount, p.payment_date, p.payment_method, p.payment_status, p.reference_number
FROM payments p LEFT JOIN students s ON p.student_id = s.id LEFT JOIN courses c ON p.course_id = c.id
WHERE contains(lower(concat_ws(chr(10), coalesce(nullif(s.name, ''), 'N/A'),
                               coalesce(nullif(c.course_name, ''), 'N/A'), CAST(p.amount AS VARCHAR),
                               CAST(p.payment_date AS VARCHAR), p.payment_method, p.payment_status,
                               p.reference_number)), '1-urgent')
""")
def q_search_payments(spark, sf_dir):
    a = Academy(spark, sf_dir)
    listing = Lst.payments_with_names(a.payments, a.students, a.courses).select(*Lst.PAYMENT_LIST_COLS)
    return S.search_payments(listing, "1-URGENT")


@query("filter_students", """
SELECT id, student_id, name, status, course_id FROM students WHERE course_id = 17 AND status = 'active'
""")
def q_filter_students(spark, sf_dir):
    s = Academy(spark, sf_dir).students.select("id", "student_id", "name", "status", "course_id")
    return S.filter_students(s, course_id=17, status="active")


@query("filter_payments", """
SELECT id, student_id, amount, payment_date, payment_status FROM payments
WHERE payment_status = 'overdue' AND payment_date >= DATE '2000-06-01'
""")
def q_filter_payments(spark, sf_dir):
    p = Academy(spark, sf_dir).payments.select("id", "student_id", "amount", "payment_date", "payment_status")
    return S.filter_payments(p, status="overdue", date_from="2000-06-01")


@query("lookup_by_id", "SELECT * FROM students WHERE id = 42")
def q_lookup_by_id(spark, sf_dir):
    return Lst.lookup_by_id(Academy(spark, sf_dir).students, 42)


@query("delete_by_ids", """
SELECT p.* FROM payments p
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = p.id AND o.o_orderstatus = 'F')
""")
def q_delete_by_ids(spark, sf_dir):
    """Delete every settled payment (ids taken from the paid orders)."""
    a = Academy(spark, sf_dir)
    paid = a.raw("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))
    return Lst.delete_by_ids(a.payments, paid)


@query("orphan_check", """
SELECT 'payments.student_id' AS relationship, count(*) AS orphans FROM payments p
  WHERE p.student_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM students s WHERE s.id = p.student_id)
UNION ALL
SELECT 'payments.course_id', count(*) FROM payments p
  WHERE p.course_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM courses c WHERE c.id = p.course_id)
UNION ALL
SELECT 'enrollments.student_id', count(*) FROM enrollments e
  WHERE e.student_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM students s WHERE s.id = e.student_id)
UNION ALL
SELECT 'enrollments.course_id', count(*) FROM enrollments e
  WHERE e.course_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM courses c WHERE c.id = e.course_id)
UNION ALL
SELECT 'students.course_id', count(*) FROM students s
  WHERE s.course_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM courses c WHERE c.id = s.course_id)
""")
def q_orphan_check(spark, sf_dir):
    a = Academy(spark, sf_dir)
    return Lst.orphan_check(a.payments, a.enrollments, a.students, a.courses)


@query("sort_mixed", """
SELECT *, row_number() OVER (ORDER BY sort_key NULLS LAST, display NULLS LAST, id) AS position FROM (
SELECT id, display, try_cast(nullif(regexp_extract(regexp_replace(display, '[^\\d.-]', '', 'g'),
                     '^(-?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) AS sort_key
FROM (SELECT id, CASE WHEN reference_number IS NULL THEN 'N/A'
                      ELSE '$' || CAST(amount AS VARCHAR) END AS display FROM payments))
""")
def q_sort_mixed(spark, sf_dir):
    """Mixed display column (money text and 'N/A') in mixed-sort order, with its numeric key."""
    p = Academy(spark, sf_dir).payments
    disp = p.select("id", F.when(F.col("reference_number").isNull(), F.lit("N/A"))
                    .otherwise(F.concat(F.lit("$"), F.col("amount").cast("string"))).alias("display"))
    ordered = number_rows(S.sort_mixed(disp, "display"))
    return ordered.select("id", "display", C.mixed_sort_key("display").alias("sort_key"), "position")


@query("sort_rows", """
SELECT id, name, admission_date, row_number() OVER (ORDER BY admission_date DESC NULLS LAST, id DESC) AS position
FROM students
""")
def q_sort_rows(spark, sf_dir):
    s = Academy(spark, sf_dir).students.select("id", "name", "admission_date")
    return number_rows(S.sort_rows(s, "admission_date", "desc", "id"))


@query("students_search_page", f"""
SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS row_no
FROM ({_STUDENT_LISTING_SQL})
WHERE status = 'active'
  AND contains(lower(concat_ws(chr(10), student_id, name, email, phone, course_name,
                               CAST(admission_date AS VARCHAR), status)), 'customer#00000')
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20
""")
def q_students_search_page(spark, sf_dir):
    """The list screen in one plan: filter -> search -> first page, newest first."""
    a = Academy(spark, sf_dir)
    listing = Lst.students_with_course(a.students, a.courses).select(*Lst.STUDENT_LIST_COLS, "created_at")
    found = S.search_students(S.filter_students(listing, status="active"), "Customer#00000")
    return Lst.page_rows(found, [F.col("created_at").desc_nulls_last(), F.col("id").desc()], page=1, per_page=20)
