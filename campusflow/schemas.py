"""Canonical entity schemas (explicit StructTypes; no inference outside tests)."""

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STUDENTS = _struct(
    ("id", L), ("student_id", S), ("name", S), ("email", S), ("phone", S), ("address", S),
    ("course_id", L), ("admission_date", D), ("status", S), ("profile_image", S), ("notes", S),
    ("created_at", TS),
)

COURSES = _struct(
    ("id", L), ("course_code", S), ("course_name", S), ("description", S), ("instructor", S),
    ("duration_weeks", I), ("price", T.DecimalType(10, 2)), ("start_date", D), ("end_date", D),
    ("status", S), ("syllabus_url", S), ("thumbnail", S), ("created_at", TS),
)

PAYMENTS = _struct(
    ("id", L), ("student_id", L), ("course_id", L), ("amount", T.DecimalType(12, 2)),
    ("payment_date", D), ("payment_method", S), ("payment_status", S), ("reference_number", S),
    ("notes", S),
)

ENROLLMENTS = _struct(
    ("id", L), ("student_id", L), ("course_id", L), ("enrollment_date", D), ("completion_date", D),
    ("status", S), ("progress", T.DecimalType(5, 2)), ("grade", S), ("certificate_url", S),
)

SCREENSHOTS = _struct(
    ("id", L), ("student_id", L), ("screenshot_type", S), ("file_path", S), ("upload_date", TS),
    ("verification_status", S), ("description", S),
)

SETTINGS = _struct(
    ("id", L), ("setting_key", S), ("setting_value", S), ("created_at", TS), ("updated_at", TS),
)

AUDIT_LOG = _struct(
    ("id", L), ("timestamp", TS), ("user_id", L), ("action", S), ("plugin", S), ("version", S),
)

BY_NAME = {
    "students": STUDENTS, "courses": COURSES, "payments": PAYMENTS, "enrollments": ENROLLMENTS,
    "screenshots": SCREENSHOTS, "settings": SETTINGS, "audit_log": AUDIT_LOG,
}

# Sums of money are cast to this type so every engine returns the same type.
MONEY_SUM = T.DecimalType(38, 2)
