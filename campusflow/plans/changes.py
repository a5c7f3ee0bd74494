"""Registered table-changing jobs (admissions, upserts, edits, purges, retention)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campusflow.operators import changes as Ch
from campusflow.plans.registry import query
from campusflow.session import checkpoint_dir
from campusflow.sources import files as Fs
from campusflow.sources import filewise as Ft
from campusflow.sources.adapters import Academy
from campusflow.streaming import jobs as J

_SPLIT_TS = "2024-01-15 00:00:00"


def _ntz(*cols):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in cols]


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _last_change_sql(src):
    return f"""(SELECT setting_key, setting_value AS v, changed_at AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY setting_key ORDER BY changed_at DESC, seq DESC) AS rn
      FROM {src}) WHERE rn = 1)"""


@query("upsert_settings", f"""
WITH c1 AS (SELECT * FROM setting_changes WHERE changed_at < TIMESTAMP '{_SPLIT_TS}'),
c2 AS (SELECT * FROM setting_changes WHERE changed_at >= TIMESTAMP '{_SPLIT_TS}'),
l1 AS {_last_change_sql('c1')},
l2 AS {_last_change_sql('c2')},
s1 AS (SELECT row_number() OVER (ORDER BY setting_key) AS id, setting_key, v AS setting_value,
              t AS created_at, t AS updated_at FROM l1),
merged AS (
  SELECT s1.id, coalesce(s1.setting_key, l2.setting_key) AS setting_key,
         CASE WHEN l2.setting_key IS NOT NULL THEN l2.v ELSE s1.setting_value END AS setting_value,
         coalesce(s1.created_at, l2.t) AS created_at,
         CASE WHEN l2.setting_key IS NOT NULL THEN l2.t ELSE s1.updated_at END AS updated_at
  FROM s1 FULL OUTER JOIN l2 ON s1.setting_key = l2.setting_key)
SELECT CASE WHEN id IS NOT NULL THEN id
            ELSE (SELECT coalesce(max(id), 0) FROM s1)
                 + row_number() OVER (PARTITION BY id IS NULL ORDER BY setting_key) END AS id,
       setting_key, setting_value, created_at, updated_at
FROM merged
""")
def q_upsert_settings(spark, sf_dir):
    """Two change batches (before / from Jan 15) applied to an empty settings table."""
    checkpoint_dir(spark)
    ch = Academy(spark, sf_dir).setting_changes
    split = F.to_timestamp(F.lit(_SPLIT_TS))
    first = Ch.upsert_settings(Ch.empty_settings(spark), ch.filter(F.col("changed_at") < split))
    second = Ch.upsert_settings(first, ch.filter(F.col("changed_at") >= split))
    return second.select("id", "setting_key", "setting_value", *_ntz("created_at", "updated_at"))


@query("keep_last_n", """
SELECT id, user_id, "timestamp", action FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM audit_log) WHERE rn <= 10
""")
def q_keep_last_n(spark, sf_dir):
    log = Academy(spark, sf_dir).audit_log.select("id", "user_id", "timestamp", "action")
    kept = Ch.keep_last_n(log, "user_id", "timestamp", "id", n=10)
    return kept.select("id", "user_id", *_ntz("timestamp"), "action")


@query("purge_like", """
SELECT setting_key, seq FROM setting_changes
WHERE NOT coalesce(setting_key LIKE '1_:%' AND NOT coalesce(setting_key LIKE '%:click', false), false)
""")
def q_purge_like(spark, sf_dir):
    """LIKE mode: ``_`` is a wildcard; clicks are exempt."""
    ch = Academy(spark, sf_dir).setting_changes.select("setting_key", "seq")
    return Ch.purge_by_key_pattern(ch, "setting_key", "1_:%", mode="like", except_pattern="%:click")


@query("purge_prefix", """
SELECT setting_key, seq FROM setting_changes WHERE NOT coalesce(starts_with(setting_key, '4'), false)
""")
def q_purge_prefix(spark, sf_dir):
    ch = Academy(spark, sf_dir).setting_changes.select("setting_key", "seq")
    return Ch.purge_by_key_pattern(ch, "setting_key", "4%", mode="prefix")


@query("update_rows", """
SELECT id, CASE WHEN duration_weeks > 40 THEN CAST(round(price * 1.1, 2) AS DECIMAL(10,2)) ELSE price END
         AS price,
       status
FROM courses
""")
def q_update_rows(spark, sf_dir):
    """Raise the price of long courses by 10%: the change set is derived from the courses."""
    courses = Academy(spark, sf_dir).courses.select("id", "price", "status", "duration_weeks")
    changes = (courses.filter(F.col("duration_weeks") > 40)
               .select("id", F.round(F.col("price") * F.lit(1.1).cast("decimal(2,1)"), 2)
                       .cast("decimal(10,2)").alias("price")))
    return Ch.update_rows(courses.drop("duration_weeks"), changes, "id")


@query("update_rows_filewise", """
SELECT id, student_id, course_id,
       CASE WHEN id BETWEEN 1000 AND 1300 THEN CAST(round(amount * 2, 2) AS DECIMAL(12,2)) ELSE amount END AS amount
FROM payments
""")
def q_update_rows_filewise(spark, sf_dir):
    """Corrections of neighbouring payments in a table of files: only the files that hold one are rewritten."""
    p = Academy(spark, sf_dir).payments.select("id", "student_id", "course_id", "amount")
    root = _scratch(spark, "payments-files")
    Ft.create_table(p, root, "id", 16)
    changes = p.filter(F.col("id").between(1000, 1300)).select(
        "id", F.round(F.col("amount") * 2, 2).cast("decimal(12,2)").alias("amount"))
    Ft.update_table(spark, root, changes)
    return Ft.read_table(spark, root)


@query("delete_by_ids_filewise", """
SELECT id, amount, payment_status FROM payments p WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderkey = p.id AND o.o_orderstatus = 'F' AND o.o_orderkey < 2000)
""")
def q_delete_by_ids_filewise(spark, sf_dir):
    """The oldest settled payments deleted from a table of files."""
    a = Academy(spark, sf_dir)
    root = _scratch(spark, "payments-files")
    Ft.create_table(a.payments.select("id", "amount", "payment_status"), root, "id", 16)
    gone = a.raw("orders").filter("o_orderstatus = 'F' and o_orderkey < 2000").select(F.col("o_orderkey").alias("id"))
    Ft.delete_from_table(spark, root, gone)
    return Ft.read_table(spark, root)


@query("purge_filewise", """
SELECT setting_key, seq FROM setting_changes WHERE NOT coalesce(starts_with(setting_key, '4'), false)
""")
def q_purge_filewise(spark, sf_dir):
    """Settings under a prefix purged from a table of files laid out by their key."""
    root = _scratch(spark, "settings-files")
    Ft.create_table(Academy(spark, sf_dir).setting_changes.select("setting_key", "seq"), root, "setting_key", 16)
    Ft.purge_table(spark, root, "setting_key", "4%", key="setting_key")
    return Ft.read_table(spark, root)


_FORM_SQL = """
form AS (
  SELECT 'STU' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 6) AS INTEGER), '0') AS student_id,
         '  ' || c_name || ' <b>new</b> ' AS name,
         upper(' ' || lower(replace(c_name, '#', '.')) || '@example.edu ') AS email,
         CASE WHEN c_acctbal < 0 THEN '0' || CAST(c_custkey AS VARCHAR)
              ELSE '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 7) AS INTEGER), '0') END AS phone,
         c_mktsegment AS address,
         CAST(c_custkey % 200 AS VARCHAR) || 'x' AS course_id,
         strftime(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') AS admission_date
  FROM customer)
"""


def _form(a):
    return a.raw("customer").selectExpr(
        "concat('STU', lpad(CAST(c_custkey AS STRING), CAST(greatest(length(CAST(c_custkey AS STRING)), 6) AS INTEGER), '0')) AS student_id",
        "concat('  ', c_name, ' <b>new</b> ') AS name",
        "upper(concat(' ', lower(replace(c_name, '#', '.')), '@example.edu ')) AS email",
        "CASE WHEN c_acctbal < 0 THEN concat('0', CAST(c_custkey AS STRING))"
        " ELSE concat('+1 (555) ', lpad(CAST(c_custkey AS STRING), CAST(greatest(length(CAST(c_custkey AS STRING)), 7) AS INTEGER), '0')) END AS phone",
        "c_mktsegment AS address",
        "concat(CAST(c_custkey % 200 AS STRING), 'x') AS course_id",
        "date_format(date_add(DATE'2024-01-01', CAST(c_custkey % 365 AS INT)), 'yyyy-MM-dd')"
        " AS admission_date")


_CLEAN_SQL = """
clean AS (
  SELECT trim(regexp_replace(regexp_replace(student_id, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS student_id,
         trim(regexp_replace(regexp_replace(name, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS name,
         CASE WHEN regexp_matches(e, '^[^@]+@[^@]+\\.[^@]+$') THEN e ELSE '' END AS email,
         trim(regexp_replace(regexp_replace(phone, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS phone,
         address,
         coalesce(try_cast(regexp_extract(trim(course_id), '^[+-]?\\d+', 0) AS BIGINT), 0) AS course_id,
         CAST(try_strptime(admission_date, '%Y-%m-%d') AS DATE) AS admission_date
  FROM (SELECT *, regexp_replace(lower(trim(email)), '[^a-z0-9.!#$%&''*+/=?^_`{|}~@-]', '', 'g') AS e
        FROM form)),
valid AS (
  SELECT * FROM clean
  WHERE trim(student_id) <> '' AND trim(name) <> '' AND trim(email) <> '' AND trim(phone) <> ''
    AND regexp_full_match(trim(email), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')
    AND regexp_full_match(regexp_replace(trim(phone), '[\\s\\-\\(\\)]', '', 'g'), '[\\+]?[1-9][\\d]{0,15}')),
existing AS (SELECT * FROM students WHERE admission_date < DATE '2024-07-01'),
fresh AS (SELECT * FROM valid WHERE student_id NOT IN (SELECT student_id FROM existing))
"""


ADMIT_SQL = f"""
WITH {_FORM_SQL}, {_CLEAN_SQL}
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY student_id) AS id,
       student_id, name, email, phone, address, course_id, admission_date, 'active' AS status
FROM fresh
"""


@query("admit_students", ADMIT_SQL)
def q_admit_students(spark, sf_dir):
    """Every customer submits an admission form; those admitted before July are already
    students, rows with a bad phone are rejected; the rest become new students."""
    checkpoint_dir(spark)
    a = Academy(spark, sf_dir)
    existing = a.students.filter(F.col("admission_date") < F.lit("2024-07-01").cast("date"))
    out = Ch.admit_students(existing, _form(a), as_of="2024-07-01 09:00:00")
    return out["students"].select("id", "student_id", "name", "email", "phone", "address", "course_id",
                                  "admission_date", "status")


ADMIT_ENROLLMENTS_SQL = f"""
WITH {_FORM_SQL}, {_CLEAN_SQL}
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY student_id) AS student_id,
       course_id, admission_date AS enrollment_date, 'active' AS status
FROM fresh
"""

ADMIT_REJECTED_SQL = f"""
WITH {_FORM_SQL}, {_CLEAN_SQL}
SELECT student_id, name, phone, array_to_string(errors, '; ') AS error_text FROM (
  SELECT *, list_filter([
      CASE WHEN student_id = '' THEN 'student_id is required' END,
      CASE WHEN name = '' THEN 'name is required' END,
      CASE WHEN email = '' THEN 'email is required' END,
      CASE WHEN email <> '' AND NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')
           THEN 'Invalid email address' END,
      CASE WHEN phone = '' THEN 'phone is required' END,
      CASE WHEN phone <> '' AND NOT regexp_full_match(regexp_replace(phone, '[\\s\\-\\(\\)]', '', 'g'),
                                                      '[\\+]?[1-9][\\d]{{0,15}}')
           THEN 'Invalid phone number' END], lambda x: x IS NOT NULL) AS errors
  FROM clean) WHERE len(errors) > 0
"""


@query("admit_students_enrollments", ADMIT_ENROLLMENTS_SQL)
def q_admit_students_enrollments(spark, sf_dir):
    checkpoint_dir(spark)
    a = Academy(spark, sf_dir)
    existing = a.students.filter(F.col("admission_date") < F.lit("2024-07-01").cast("date"))
    return Ch.admit_students(existing, _form(a), as_of="2024-07-01 09:00:00")["enrollments"]


@query("append_keep_last_n", """
SELECT id, user_id, "timestamp", action FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM audit_log) WHERE rn <= 10
""")
def q_append_keep_last_n(spark, sf_dir):
    """The log kept to 10 per user before Jan 15, then the later entries appended and trimmed:
    equal to trimming the whole log at once."""
    log = Academy(spark, sf_dir).audit_log.select("id", "user_id", "timestamp", "action")
    split = F.to_timestamp(F.lit(_SPLIT_TS))
    kept = Ch.keep_last_n(log.filter(F.col("timestamp") < split), "user_id", "timestamp", "id", 10)
    out = Ch.append_keep_last_n(kept, log.filter(F.col("timestamp") >= split), "user_id", "timestamp", "id", 10)
    return out.select("id", "user_id", *_ntz("timestamp"), "action")


@query("append_log_stored", """
SELECT id, user_id, "timestamp", action FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM audit_log) WHERE rn <= 10
""")
def q_append_log_stored(spark, sf_dir):
    """The written log, appended to and trimmed in two versions."""
    log = Academy(spark, sf_dir).audit_log.select("id", "user_id", "timestamp", "action")
    split, root = F.to_timestamp(F.lit(_SPLIT_TS)), _scratch(spark, "log")
    for number, part in enumerate((F.col("timestamp") < split, F.col("timestamp") >= split)):
        J.append_log(log.filter(part), root, "user_id", "timestamp", "id", f"log-{number}", 10)
    return J.read_log(spark, root).select("id", "user_id", *_ntz("timestamp"), "action")


@query("import_admissions", ADMIT_SQL)
def q_import_admissions(spark, sf_dir):
    """The same forms uploaded as CSV: read as text, rows that do not fit the columns set aside, the
    rest admitted."""
    a = Academy(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/admissions-csv-{uuid.uuid4().hex}"
    form = _form(a)
    Fs.export_csv(form, path)
    good, _ = Fs.import_csv(spark, path, form.schema)
    existing = a.students.filter(F.col("admission_date") < F.lit("2024-07-01").cast("date"))
    out = Ch.admit_students(existing, good, as_of="2024-07-01 09:00:00")
    return out["students"].select("id", "student_id", "name", "email", "phone", "address", "course_id",
                                  "admission_date", "status")
