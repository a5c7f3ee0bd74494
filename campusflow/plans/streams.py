"""Registered streaming operators: each batch twin and its stream (drained with
``availableNow`` into Parquet in the shared folder) share one oracle, cut to the groups that the
watermark has closed where the stream aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campusflow.operators.bursts import debounce_batch
from campusflow.operators.throttle import throttle_batch
from campusflow.plans.changes import ADMIT_ENROLLMENTS_SQL, ADMIT_REJECTED_SQL, ADMIT_SQL, _form
from campusflow.plans.registry import AS_OF_SALES, query
from campusflow.session import checkpoint_dir
from campusflow.sources.adapters import Academy
from campusflow.streaming import jobs as J
from campusflow.streaming import kept as K
from campusflow.streaming import operators as S


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, sf_dir):
    ev = Academy(spark, sf_dir).raw("events")
    # one file per trigger bounds what a key can bring to a task at once
    return J.file_stream(spark, sf_dir, ev.schema, glob="events.parquet", max_files_per_trigger=1)


def _arriving_events(spark, sf_dir, slices=2):
    """The events as a source that brings them in time order, a slice per micro-batch: what a key can bring to a task
    at once is bounded by a slice.  Slices are written one after the other, as the source goes by the files' age."""
    ev = Academy(spark, sf_dir).raw("events")
    path = _scratch(spark, "events")
    cuts = ev.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")),
                                      [i / slices for i in range(1, slices)]).alias("c")).first()["c"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = ev.filter(F.lit(True) if low is None else at >= low).filter(F.lit(True) if high is None else at < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(spark, path, ev.schema, max_files_per_trigger=1)


def _ntz(*cols):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in cols]


_DEBOUNCE_SQL = """
WITH e AS (SELECT user_id, ts, event_id, value,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
b AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM e)
SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS events,
       arg_max(event_id, ts) AS last_event_id, arg_max(value, ts) AS last_value
FROM b GROUP BY user_id, burst
"""


@query("debounce_events", _DEBOUNCE_SQL)
def q_debounce_events(spark, sf_dir):
    """Per-user bursts of events no more than 30 minutes apart, the last event kept
    (the skew-proof batch job; the stream below uses session windows)."""
    checkpoint_dir(spark)
    d = debounce_batch(Academy(spark, sf_dir).raw("events"), "user_id", wait_seconds=1800, keep="last",
                       payload=("value",))
    return d.select("user_id", *_ntz("burst_start", "burst_end"), "events", "last_event_id", "last_value")


@query("debounce_stream", f"""SELECT * FROM ({_DEBOUNCE_SQL})
WHERE burst_end + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_debounce_stream(spark, sf_dir):
    """The same bursts from the event stream: those that the watermark has closed."""
    out = S.debounce_events(_events_stream(spark, sf_dir), "user_id", wait="30 minutes", keep="last",
                            payload=("value",), watermark="1 hour")
    t = J.run_to_table(out, _scratch(spark, "debounce"), _scratch(spark, "ck-debounce"))
    return t.select("user_id", *_ntz("burst_start", "burst_end"), "events", "last_event_id", "last_value")


_LIVE_SQL = """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS value_sum
FROM events GROUP BY ALL
"""


@query("live_stats", _LIVE_SQL)
def q_live_stats(spark, sf_dir):
    s = S.live_stats(Academy(spark, sf_dir).raw("events"), every="1 day")
    return s.select(*_ntz("window_start", "window_end"), "event_type", "events", "value_sum")


@query("live_stats_stream", f"""SELECT * FROM ({_LIVE_SQL})
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_live_stats_stream(spark, sf_dir):
    out = S.live_stats(_events_stream(spark, sf_dir), every="1 day", watermark="1 hour")
    t = J.run_to_table(out, _scratch(spark, "live"), _scratch(spark, "ck-live"))
    return t.select(*_ntz("window_start", "window_end"), "event_type", "events", "value_sum")


_THROTTLE_SQL = """
WITH RECURSIVE t(user_id, ts) AS (
  SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL
  SELECT n.user_id, n.ts FROM t, LATERAL (
    SELECT e.user_id, min(e.ts) AS ts FROM events e
    WHERE e.user_id = t.user_id AND e.ts >= t.ts + INTERVAL 6 HOUR GROUP BY e.user_id) n)
SELECT t.user_id, t.ts, e.event_id, e.event_type
FROM t JOIN events e ON e.user_id = t.user_id AND e.ts = t.ts
"""


@query("throttle_batch", _THROTTLE_SQL)
def q_throttle_batch(spark, sf_dir):
    """Per user, an event then silence for 6 hours: the skew-proof batch job."""
    checkpoint_dir(spark)
    ev = Academy(spark, sf_dir).raw("events")
    out = throttle_batch(ev, "user_id", limit_seconds=6 * 3600, payload=["event_type"])
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")


@query("throttle_events", _THROTTLE_SQL)
def q_throttle_events(spark, sf_dir):
    """Per user, an event then silence for 6 hours (greedy), from the event stream."""
    out = S.throttle_events(_arriving_events(spark, sf_dir), "user_id", limit_seconds=6 * 3600,
                            payload=("event_type",))
    t = J.run_to_table(out, _scratch(spark, "throttle"), _scratch(spark, "ck-throttle"))
    return t.select("user_id", *_ntz("ts"), "event_id", "event_type")


@query("throttle_event_time", f"""SELECT * FROM ({_THROTTLE_SQL})
WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def q_throttle_event_time(spark, sf_dir):
    """The same decided in event time: what the watermark has passed, with state over micro-batches."""
    out = S.throttle_in_event_time(_arriving_events(spark, sf_dir), "user_id", "2 days", limit_seconds=6 * 3600,
                                   payload=("event_type",))
    t = J.run_to_table(out, _scratch(spark, "throttle"), _scratch(spark, "ck-throttle"))
    return t.select("user_id", *_ntz("ts"), "event_id", "event_type")


@query("stream_audit", """
SELECT id, "timestamp", user_id, action, plugin, version FROM audit_log
""")
def q_stream_audit(spark, sf_dir):
    sink = _scratch(spark, "audit")
    q = J.stream_audit(_events_stream(spark, sf_dir), sink, _scratch(spark, "ck-audit"))
    q.awaitTermination()
    t = spark.read.parquet(sink)
    return t.select("id", *_ntz("timestamp"), "user_id", "action", "plugin", "version")


@query("stream_upsert", """
SELECT row_number() OVER (ORDER BY setting_key) AS id, setting_key, setting_value,
       changed_at AS created_at, changed_at AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY setting_key ORDER BY changed_at DESC, seq DESC) AS rn
      FROM setting_changes) WHERE rn = 1
""")
def q_stream_upsert(spark, sf_dir):
    """Setting changes arriving as a stream, applied by versioned foreachBatch upserts."""
    stream = _events_stream(spark, sf_dir)
    changes = stream.selectExpr("concat(CAST(user_id AS STRING), ':', event_type) AS setting_key",
                                "props AS setting_value", "CAST(ts AS TIMESTAMP) AS changed_at",
                                "event_id AS seq")
    root = _scratch(spark, "settings")
    J.stream_upsert(changes, root, _scratch(spark, "ck-upsert")).awaitTermination()
    return J.latest_settings(spark, root).select("id", "setting_key", "setting_value",
                                                 *_ntz("created_at", "updated_at"))


def _admit_stream(spark, sf_dir):
    """Admission forms arriving as files into a table of earlier students: the three output paths."""
    a = Academy(spark, sf_dir)
    students, enrollments, rejected = (_scratch(spark, n) for n in ("students", "enrollments", "rejected"))
    forms_path = _scratch(spark, "forms")
    existing = a.students.filter(F.col("admission_date") < F.lit("2024-07-01").cast("date"))
    existing.write.parquet(students)
    form = _form(a)
    form.write.parquet(forms_path)
    stream = J.file_stream(spark, forms_path, form.schema)
    J.stream_admissions(stream, students, enrollments, _scratch(spark, "ck-admit"), as_of="2024-07-01 09:00:00",
                        rejected_path=rejected).awaitTermination()
    return students, enrollments, rejected


@query("stream_admissions", ADMIT_SQL)
def q_stream_admissions(spark, sf_dir):
    """The new students as stored by the stream (the same rows as ``admit_students``, hence the same oracle)."""
    students, _, _ = _admit_stream(spark, sf_dir)
    new = spark.read.parquet(students, mergeSchema=True).filter(F.col("admitted_in").isNotNull())
    return new.select("id", "student_id", "name", "email", "phone", "address", "course_id",
                      "admission_date", "status")


@query("stream_admissions_enrollments", ADMIT_ENROLLMENTS_SQL)
def q_stream_admissions_enrollments(spark, sf_dir):
    _, enrollments, _ = _admit_stream(spark, sf_dir)
    return spark.read.parquet(enrollments).select("student_id", "course_id", "enrollment_date", "status")


@query("stream_admissions_rejected", ADMIT_REJECTED_SQL)
def q_stream_admissions_rejected(spark, sf_dir):
    _, _, rejected = _admit_stream(spark, sf_dir)
    return spark.read.parquet(rejected).select("student_id", "name", "phone",
                                               F.array_join("errors", "; ").alias("error_text"))


def _overlapping(spark, df, key, name):
    """``df`` as a source of two micro-batches that share rows, as changed rows come again."""
    path = _scratch(spark, name)
    low, high = df.agg(F.percentile_approx(key, [0.4, 0.6]).alias("p")).first()["p"]
    df.filter(F.col(key) <= high).coalesce(1).write.mode("append").parquet(path)
    df.filter(F.col(key) > low).coalesce(1).write.mode("append").parquet(path)
    return J.file_stream(spark, path, df.schema, max_files_per_trigger=1)


@query("live_dashboard", f"""
SELECT (SELECT count(*) FROM students) AS total_students, (SELECT count(*) FROM courses) AS total_courses,
       count(*) AS total_payments, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_revenue,
       CAST(coalesce(sum(amount) FILTER (WHERE payment_status = 'pending'), 0) AS DECIMAL(38,2)) AS pending_fees,
       CAST(coalesce(sum(amount) FILTER (WHERE payment_status = 'overdue'), 0) AS DECIMAL(38,2)) AS overdue_fees,
       CAST(coalesce(sum(amount) FILTER (WHERE date_trunc('month', payment_date)
            = date_trunc('month', DATE '{AS_OF_SALES[:10]}')), 0) AS DECIMAL(38,2)) AS monthly_revenue
FROM payments
""")
def q_live_dashboard(spark, sf_dir):
    """All figures of the dashboard, kept by streams of students, courses (rows come again) and payments."""
    a = Academy(spark, sf_dir)
    orders = a.raw("orders")
    stream = J.file_stream(spark, sf_dir, orders.schema, glob="orders.parquet", max_files_per_trigger=1)
    payments = stream.selectExpr(
        "CAST(o_totalprice AS DECIMAL(12,2)) AS amount", "CAST(o_orderdate AS DATE) AS payment_date",
        "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END AS payment_status")
    root = _scratch(spark, "figures")
    for q in K.stream_dashboard(_overlapping(spark, a.students.select("id", "name"), "id", "students"),
                                _overlapping(spark, a.courses.select("id", "course_name"), "id", "courses"),
                                payments, root, _scratch(spark, "ck-figures")):
        q.awaitTermination()
    return K.live_dashboard(spark, root, AS_OF_SALES)


_FINAL_ACTIVITY = """
WITH e AS (SELECT enrollment_date AS d FROM enrollments),
p AS (SELECT payment_date AS d, CASE WHEN payment_method = '1-URGENT' THEN amount + 1 ELSE amount END AS amount
      FROM payments WHERE payment_status != 'overdue')
SELECT {period} AS {name}, CAST(sum(en) AS BIGINT) AS enrollments, CAST(sum(pn) AS BIGINT) AS payments,
       CAST(sum(rev) AS DECIMAL(38,2)) AS revenue
FROM (SELECT d, 1 AS en, 0 AS pn, CAST(0 AS DECIMAL(12,2)) AS rev FROM e WHERE d IS NOT NULL
      UNION ALL SELECT d, 0, 1, amount FROM p WHERE d IS NOT NULL) GROUP BY 1
"""


def _kept_activity(spark, sf_dir):
    """Old rows, then late and new ones, then corrected amounts and withdrawn payments, merged one after the other."""
    a = Academy(spark, sf_dir)
    root = _scratch(spark, "activity")
    e, p = a.enrollments.select("enrollment_date"), a.payments.select("payment_date", "amount", "payment_method", "payment_status")
    new = F.lit(1).cast("bigint").alias("sign")
    old_e, old_p = F.col("enrollment_date") < "1998-01-01", F.col("payment_date") < "1998-01-01"
    K.apply_activity(spark, root, "load-0", e.filter(old_e).select("*", new), p.filter(old_p).select("*", new))
    K.apply_activity(spark, root, "late-1", e.filter(~old_e).select("*", new), p.filter(~old_p).select("*", new))
    fixed = (p.filter("payment_status != 'overdue'").withColumn("amount", F.when(
        F.col("payment_method") == "1-URGENT", F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(12,2)")))
    K.apply_activity(spark, root, "corrections-2", payments=K.signed_changes(p, fixed))
    return root


@query("daily_stats_kept", _FINAL_ACTIVITY.format(period="d", name="day"))
def q_daily_stats_kept(spark, sf_dir):
    return K.kept_daily_stats(spark, _kept_activity(spark, sf_dir))


@query("monthly_summary_kept", _FINAL_ACTIVITY.format(period="CAST(date_trunc('month', d) AS DATE)", name="month"))
def q_monthly_summary_kept(spark, sf_dir):
    return K.kept_monthly_summary(spark, _kept_activity(spark, sf_dir))


@query("debounce_first", """
WITH e AS (SELECT user_id, ts, event_id, event_type,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
b AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 5 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM e)
SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS events,
       arg_min(event_id, ts) AS first_event_id, arg_min(event_type, ts) AS first_event_type
FROM b GROUP BY user_id, burst
""")
def q_debounce_first(spark, sf_dir):
    """Leading-edge debounce: bursts at 5 minutes, the first event kept."""
    checkpoint_dir(spark)
    d = debounce_batch(Academy(spark, sf_dir).raw("events"), "user_id", wait_seconds=300, keep="first",
                       payload=("event_type",))
    return d.select("user_id", *_ntz("burst_start", "burst_end"), "events", "first_event_id",
                    "first_event_type")
