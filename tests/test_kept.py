"""Figures kept by streams and by signed changes, against a recompute over all rows."""

import datetime as dt
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campusflow.operators import reports, stats
from campusflow.session import checkpoint_dir
from campusflow.sources import manifest as Mf
from campusflow.streaming import kept as K

AS_OF = "2024-02-10"
PAYMENT = "id long, amount decimal(12,2), payment_date date, payment_status string"
PERSON = "id long, name string"
ENROLLMENT = "id long, enrollment_date date"


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _payment(rnd, i):
    day = None if rnd.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(120))
    amount = None if rnd.random() < 0.05 else Decimal(rnd.randrange(1, 99999)) / 100
    return i, amount, day, rnd.choice(["paid", "pending", "overdue", None])


def test_live_dashboard_equals_batch_after_each_trigger(spark):
    """Students and courses that come again, within a trigger and in later ones; payments of many months."""
    rnd = random.Random(1)
    sources = [_scratch(spark, n) for n in ("students", "courses", "payments")]
    root, ck = _scratch(spark, "figures"), _scratch(spark, "ck")
    seen = [{}, {}, {}]
    for trigger in range(3):
        students = [(rnd.randrange(60), f"n{trigger}") for _ in range(40)] + [(None, "nobody")]
        courses = [(rnd.randrange(9), "c") for _ in range(5)]
        payments = [_payment(rnd, 100 * trigger + i) for i in range(30)]
        for rows, path, schema, held in zip((students, courses, payments), sources, (PERSON, PERSON, PAYMENT), seen):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            held.update({r[0]: r for r in rows if r[0] is not None})
        streams = [spark.readStream.schema(s).parquet(p) for p, s in zip(sources, (PERSON, PERSON, PAYMENT))]
        for q in K.stream_dashboard(*streams, root, ck):
            q.awaitTermination()
        want = stats.dashboard_stats(*[spark.createDataFrame(list(h.values()), s)
                                       for h, s in zip(seen, (PERSON, PERSON, PAYMENT))], as_of=AS_OF)
        got = K.live_dashboard(spark, root, AS_OF)
        assert got.columns == want.columns and got.first() == want.first()
    assert Mf.versions(spark, f"{root}/payments") == [1, 2]


def test_a_replayed_batch_counts_once(spark):
    root = _scratch(spark, "figures")
    payments = spark.createDataFrame([(1, Decimal("2.50"), dt.date(2024, 2, 1), "pending")], PAYMENT)
    people = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], PERSON)
    for batch in (0, 1, 1):
        K.payments_batch(payments, f"{root}/payments", batch)
        K.count_batch(people, f"{root}/students", batch)
        K.count_batch(people.limit(0), f"{root}/courses", batch)
    got = K.live_dashboard(spark, root, AS_OF).first()
    assert (got.total_students, got.total_courses, got.total_payments) == (2, 0, 2)
    assert got.pending_fees == got.monthly_revenue == Decimal("5.00")


def test_nothing_arrived_yet(spark):
    got = K.live_dashboard(spark, _scratch(spark, "none"), AS_OF).first()
    assert tuple(got) == (0, 0, 0, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))


def _dated(df, col):
    return df.filter(F.col(col).isNotNull())


@pytest.mark.parametrize("seed", [2, 3])
def test_kept_stats_after_random_changes(spark, seed):
    """Inserts, updates and deletes in random months: equal to a full recompute, other months' files untouched."""
    rnd, root = random.Random(seed), _scratch(spark, "activity")
    payments = {i: _payment(rnd, i) for i in range(200)}
    enrollments = {i: (i, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(120))) for i in range(200)}
    frames = lambda: (spark.createDataFrame(list(enrollments.values()), ENROLLMENT),
                      spark.createDataFrame(list(payments.values()), PAYMENT))
    empty = spark.createDataFrame([], ENROLLMENT), spark.createDataFrame([], PAYMENT)
    before = empty
    for step in range(3):
        if step:
            month = dt.date(2024, step, 1)
            inside = lambda d: d is not None and d.replace(day=1) == month
            for i in [i for i, p in payments.items() if inside(p[2])]:
                if rnd.random() < 0.3:
                    del payments[i]
                elif rnd.random() < 0.5:
                    payments[i] = (i, Decimal(rnd.randrange(1, 999)), payments[i][2], "paid")
            for i in range(20):
                enrollments[1000 * step + i] = (i, month + dt.timedelta(days=rnd.randrange(28)))
        now = frames()
        paths = {e.month: e.path for e in Mf.manifest(spark, root, Mf.versions(spark, root)[-1]).collect()} if step else {}
        K.apply_activity(spark, root, f"s-{step}", K.signed_changes(before[0], now[0]), K.signed_changes(before[1], now[1]))
        e, p = _dated(now[0], "enrollment_date"), _dated(now[1], "payment_date")
        assert sorted(map(tuple, K.kept_daily_stats(spark, root).collect())) == sorted(map(tuple, reports.daily_stats(e, p).collect()))
        assert sorted(map(tuple, K.kept_monthly_summary(spark, root).collect())) == sorted(
            map(tuple, reports.monthly_summary(e, p).collect()))
        if step:
            after = {e.month: e.path for e in Mf.manifest(spark, root, Mf.versions(spark, root)[-1]).collect()}
            assert {m for m in after if after[m] != paths.get(m)} == {month}
        before = now


def test_a_month_that_loses_all_rows_goes(spark):
    root = _scratch(spark, "activity")
    row = spark.createDataFrame([(dt.date(2024, 1, 5), Decimal("3.00"))], "payment_date date, amount decimal(12,2)")
    sign = lambda n: row.withColumn("sign", F.lit(n).cast("bigint"))
    K.apply_activity(spark, root, "a-0", payments=sign(1))
    for _ in range(2):  # the second is a replay
        K.apply_activity(spark, root, "a-1", payments=sign(-1))
    assert K.kept_daily_stats(spark, root).count() == 0 and K.kept_monthly_summary(spark, root).count() == 0
    for i in (2, 3, 4):  # the version without files is retired meanwhile
        K.apply_activity(spark, root, f"a-{i}", payments=sign(1 if i == 2 else 0))
    assert K.kept_monthly_summary(spark, root).first().revenue == Decimal("3.00")
