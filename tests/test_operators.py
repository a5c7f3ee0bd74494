"""Operator edge cases on hand-made rows (FIXTURES.md section 3) and properties."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusflow import schemas
from campusflow.functions import columns as C
from campusflow.operators import changes as Ch
from campusflow.operators import listings as Lst
from campusflow.operators import quality as Q
from campusflow.operators import stats
from campusflow.sources import files as Fs
from campusflow.sources.csv_records import csv_records


def test_empty_payments_give_zero(spark):
    students = spark.createDataFrame([], schemas.STUDENTS)
    courses = spark.createDataFrame([], schemas.COURSES)
    payments = spark.createDataFrame([], schemas.PAYMENTS)
    r = stats.dashboard_stats(students, courses, payments, as_of="2024-01-15").collect()[0]
    assert r.total_payments == 0 and r.total_revenue == Decimal("0.00") and r.monthly_revenue == Decimal("0.00")
    assert stats.pending_fees(payments).collect()[0].pending_fees == Decimal("0.00")


def test_missing_course_is_na(spark):
    s = spark.createDataFrame([(1, 0), (2, 99), (3, 5)], "id bigint, course_id bigint")
    c = spark.createDataFrame([(5, "Maths")], "id bigint, course_name string")
    got = {r.id: r.course_name for r in Lst.students_with_course(s, c).collect()}
    assert got == {1: "N/A", 2: "N/A", 3: "Maths"}


def test_purge_patterns(spark):
    df = spark.createDataFrame([("cf_academy_x",), ("cfXacademyYz",), ("other",), (None,)], "k string")
    like = sorted(str(r.k) for r in Ch.purge_by_key_pattern(df, "k", "cf_academy_%", mode="like").collect())
    assert like == ["None", "other"]
    prefix = sorted(str(r.k) for r in Ch.purge_by_key_pattern(df, "k", "cf_academy_%").collect())
    assert prefix == ["None", "cfXacademyYz", "other"]


def test_keep_last_10_tie_by_id(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "k", base + dt.timedelta(minutes=i)) for i in range(12)]
    rows[11] = (11, "k", rows[10][2])  # same time as id 10
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    kept = sorted(r.id for r in Ch.keep_last_n(df, "key", "ts", "id", 10).collect())
    assert kept == list(range(2, 12))


def test_upsert_cases(spark):
    t0, t1, t2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
    current = spark.createDataFrame([(1, "theme", "light", t0, t0), (2, "logo", "a.png", t0, t0)],
                                    schemas.SETTINGS)
    changes = spark.createDataFrame([("theme", "dark", t1, 1), ("name", "Acad", t1, 2),
                                     ("name", "Academy", t2, 3)],
                                    "setting_key string, setting_value string, changed_at timestamp, seq long")
    out = {r.setting_key: r for r in Ch.upsert_settings(current, changes).collect()}
    assert out["theme"].setting_value == "dark" and out["theme"].created_at == t0 and out["theme"].updated_at == t1
    assert out["name"].setting_value == "Academy" and out["name"].created_at == t2 and out["name"].id == 3
    assert out["logo"].setting_value == "a.png" and out["logo"].updated_at == t0
    # applying the same batch twice equals applying it once
    again = Ch.upsert_settings(Ch.upsert_settings(current, changes), changes)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, Ch.upsert_settings(current, changes).collect()))


def test_assign_ids_dense(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    base = spark.createDataFrame([(41,), (7,)], "id long")
    ids = Ch.assign_ids(df.repartition(7), ["k"], base=base).orderBy("k").collect()
    assert [r.id for r in ids] == list(range(42, 5042))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c'), (2, "line\nbreak"), (3, None), (4, "")], "id long, v string")
    Fs.export_csv(df, str(tmp_path / "plain"))
    good, bad = Fs.import_csv(spark, str(tmp_path / "plain"), df.schema, multi_line=True)
    got = {r.id: r.v for r in good.collect()}
    assert got == {1: 'a"b,c', 2: "line\nbreak", 3: None, 4: None} and bad.count() == 0
    Fs.export_csv(df, str(tmp_path / "marked"), null_value="\\N")
    good, _ = Fs.import_csv(spark, str(tmp_path / "marked"), df.schema, null_value="\\N", multi_line=True)
    assert {r.id: r.v for r in good.collect()} == {1: 'a"b,c', 2: "line\nbreak", 3: None, 4: ""}


def test_validate_split_is_partition(spark, sf_small):
    from campusflow.operators import quality as Q
    from campusflow.sources.adapters import Academy
    s = Academy(spark, sf_small).students
    v = Q.validate_rows(s.withColumn("phone", F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise(F.col("phone"))),
                        required=["name"], email=["email"], phone=["phone"])
    good, bad = Q.split_valid(v)
    assert good.count() + bad.count() == s.count() and bad.count() == 50


def test_pages_cover_listing(spark, sf_small):
    from campusflow.sources.adapters import Academy
    a = Academy(spark, sf_small)
    listing = Lst.students_with_course(a.students, a.courses).select("id", "created_at")
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    ids = []
    for p in range(1, 9):
        ids += [r.id for r in Lst.page_rows(listing, order, page=p, per_page=20).orderBy("row_no").collect()]
    full = [r.id for r in listing.orderBy(*order).collect()]
    assert ids == full


def test_drop_dataset_needs_confirm(spark):
    import pytest
    with pytest.raises(ValueError):
        Ch.drop_dataset(spark, ["nope"])
    spark.range(3).write.mode("overwrite").saveAsTable("cf_tmp_drop")
    assert Ch.drop_dataset(spark, ["cf_tmp_drop", "cf_missing"], confirm=True) == ["cf_tmp_drop"]


def test_listings_are_ordered(spark, sf_small):
    import __spark_entry__ as entry
    q = entry.queries()
    rows = q["list_students"](spark, sf_small).collect()
    keys = [(r.created_at, r.id) for r in rows]
    assert keys == sorted(keys, reverse=True) and len(keys) == 150
    rows = q["list_payments"](spark, sf_small).collect()
    keys = [(r.payment_date, r.id) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_filter_sentinels_and_lookup(spark):
    from campusflow.operators import search as S
    df = spark.createDataFrame([(1, 5, "active"), (2, 5, "inactive"), (3, 6, "active")],
                               "id long, course_id long, status string")
    assert S.filter_students(df).count() == 3                      # 0 / '' mean "any"
    assert [r.id for r in S.filter_students(df, course_id=5).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in S.filter_students(df, 5, "active").collect()] == [1]
    assert [r.id for r in Lst.lookup_by_id(df, 3).collect()] == [3]


def test_update_rows_keeps_old_on_null(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, n int")
    ch = spark.createDataFrame([(1, None, 11), (3, "z", 30)], "id long, name string, n long")
    got = {r.id: (r.name, r.n) for r in Ch.update_rows(df, ch).collect()}
    assert got == {1: ("a", 11), 2: ("b", 20)}                     # unknown id 3 is not inserted


def test_delete_by_ids_ignores_null_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    ids = spark.createDataFrame([(2,), (None,)], "id long")
    assert sorted(str(r.id) for r in Lst.delete_by_ids(df, ids).collect()) == ["1", "None"]


def test_distribution_without_other_and_zero_filled_months(spark):
    from campusflow.operators import series as Sr
    e = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 3, 2)), (2, dt.date(2024, 3, 9))],
                              "course_id long, enrollment_date date")
    c = spark.createDataFrame([(1, "One"), (2, "")], "id long, course_name string")
    dist = {r.label: (r.rank, r.enrollments) for r in Sr.enrollment_distribution(e, c, top=4).collect()}
    assert dist == {"One": (1, 2), "N/A": (2, 1)}                  # no 'Other' row with 2 courses
    months = [(r.label, r.enrollments) for r in
              Sr.enrollments_by_month(e, "2024-03-20 10:00:00", period=4).orderBy("month").collect()]
    assert months == [("2023-12", 0), ("2024-01", 1), ("2024-02", 0), ("2024-03", 2)]


def test_keyset_pages_ascending(spark):
    df = spark.range(1, 31).select(F.col("id"), (F.col("id") % 3).alias("k"))
    first = Lst.page_after(df, "k", "id", -1, 0, per_page=7, descending=False).collect()
    last = first[-1]
    second = Lst.page_after(df, "k", "id", last.k, last.id, per_page=7, descending=False).collect()
    every = sorted(df.collect(), key=lambda r: (r.k, r.id))
    assert [r.id for r in first + second] == [r.id for r in every[:14]]


def test_orphan_check_fixture(spark):
    st = spark.createDataFrame([(1, 5), (2, 99), (3, None)], "id long, course_id long")
    co = spark.createDataFrame([(5,)], "id long")
    pay = spark.createDataFrame([(10, 1, 5), (11, 7, 5), (12, 7, 6), (13, None, None)],
                                "id long, student_id long, course_id long")
    en = spark.createDataFrame([(20, 2, 5)], "id long, student_id long, course_id long")
    got = dict(tuple(r) for r in Lst.orphan_check(pay, en, st, co).collect())
    assert got == {"payments.student_id": 2, "payments.course_id": 1, "enrollments.student_id": 0,
                   "enrollments.course_id": 0, "students.course_id": 1}


def test_admissions_into_an_empty_academy(spark, sf_small):
    """Starting from no students, every valid form is admitted with ids 1..n in code order."""
    from campusflow.plans.changes import _form
    from campusflow.sources.adapters import Academy
    out = Ch.admit_students(Ch.empty_students(spark), _form(Academy(spark, sf_small)), "2024-07-01 09:00:00")
    rows = out["students"].orderBy("student_id").collect()
    rejected = out["rejected"].count()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    assert len(rows) + rejected == 150 and rejected > 0
    assert out["enrollments"].count() == len(rows)


@pytest.fixture
def split_bytes(spark):
    """Sets the size at which Spark cuts files."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


@pytest.mark.parametrize("size", [31, 500, 10_000_000])
def test_multi_line_csv_from_many_splits(spark, tmp_path, split_bytes, size):
    """Quoted line breaks at any place of the splits, equal to what was written and to a reader of whole files."""
    rnd = random.Random(size)
    rows = [(i, "".join(rnd.choice(["a", '"', "\n", ",", "\r\n", "é", " ", '"\n"']) for _ in range(rnd.choice([1, 4, 20, 90]))),
             i * 2) for i in range(60 if size < 64 else 300)]
    df = spark.createDataFrame(rows, "id long, note string, n long")
    Fs.export_csv(df.coalesce(2), str(tmp_path / "o"))
    split_bytes(size)
    records = csv_records(spark, str(tmp_path / "o"))
    assert size > 500 or records.rdd.getNumPartitions() > 20
    good, bad = Fs.import_csv(spark, str(tmp_path / "o"), df.schema, multi_line=True)
    whole = spark.read.schema(df.schema).options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "o"))
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, whole.collect())) == rows and bad.count() == 0


@pytest.mark.parametrize("size", [5, 1000])
def test_multi_line_csv_keeps_good_and_bad_records(spark, tmp_path, split_bytes, size):
    (tmp_path / "a.csv").write_text('id,name\r\n1,"x\ny"\r\n2,y,LOST\r\n\r\n3\r\nq,"z\r\n""z"""\r\n4,ok')
    (tmp_path / "b.csv").write_text('id,name\n5,"never\nclosed\n')
    (tmp_path / "c.csv").write_text("")
    split_bytes(size)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = Fs.import_csv(spark, str(tmp_path), schema, multi_line=True)
    assert sorted(map(tuple, good.collect()))[:2] == [(1, "x\ny"), (4, "ok")]
    assert {(r.id, tuple(r.errors)) for r in bad.collect()} >= {
        ("2", ("wrong number of fields",)), ("3", ("wrong number of fields",)), ("q", ("id: not bigint",))}
    assert good.count() + bad.count() == 6
    assert csv_records(spark, str(tmp_path / "a.csv"), header=False).first().value == "id,name"


def test_import_csv_rejects_lines_of_other_width(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,x\n2,y,LOST\n3\nq,z\n4,ok\n")
    good, bad = Fs.import_csv(spark, str(tmp_path / "in.csv"), T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))
    assert sorted(map(tuple, good.collect())) == [(1, "x"), (4, "ok")]
    got = {r.id: (r.errors, r.line) for r in bad.collect()}
    assert got == {"2": (["wrong number of fields"], "2,y,LOST"), "3": (["wrong number of fields"], "3"),
                   "q": (["id: not bigint"], None)}


def test_update_rows_applies_one_change_per_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, n int")
    ch = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (1, None, 7)], "id long, name string, seq int")
    assert sorted(map(tuple, Ch.update_rows(df, ch, order_by="seq").collect())) == [(1, "a", 1), (2, "b", 2)]
    assert Ch.update_rows(df, ch.drop("seq")).count() == 2


def test_totals_beyond_eighteen_digits(spark):
    from campusflow.operators import stats
    pay = spark.range(0, 2_000_000, numPartitions=4).selectExpr(
        "CAST(9999999999.99 AS DECIMAL(12,2)) AS amount", "'pending' AS payment_status")
    total = stats.pending_fees(pay).first()[0]
    assert total == Decimal("9999999999.99") * 2_000_000 and total > 10 ** 16


def test_admission_codes_of_long_ids_stay_distinct(spark):
    ids = spark.range(1_000_000, 1_000_100)
    codes = [r[0] for r in ids.select(C.admission_code("id")).collect()]
    assert len(set(codes)) == 100 and "STU1000000" in codes
    assert spark.range(7, 8).select(C.admission_code("id")).first()[0] == "STU000007"


def test_numbers_follow_the_order_of_the_rows(spark):
    df = spark.range(0, 500, numPartitions=7).selectExpr("id", "id % 13 AS k")
    got = Ch.number_rows(df.orderBy(F.col("k").desc(), "id")).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 501))
    assert [(r.k, r.id) for r in got] == sorted(((i % 13, i) for i in range(500)), key=lambda x: (-x[0], x[1]))


def test_screenshot_review_reads_its_own_schema(spark):
    from campusflow import schemas
    from campusflow.operators import reports as R
    row = (1, 2, "face", "p", dt.datetime(2024, 1, 1), "pending", None)
    out = R.screenshot_review(spark.createDataFrame([row], schemas.SCREENSHOTS), "2024-02-01 00:00:00").first()
    assert (out.files, out.total_bytes, out.total_size, out.max_age_days) == (1, None, None, 31)


def test_payments_without_student_or_course_are_spread(spark):
    rows = [(i, 1 if i % 3 else None, 5 if i % 2 else None, None) for i in range(300)]
    payments = spark.createDataFrame(rows, "id long, student_id long, course_id long, reference_number string")
    students = spark.createDataFrame([(1, "Ann")], "id long, name string")
    courses = spark.createDataFrame([(5, "Maths")], "id long, course_name string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        out = Lst.payments_with_names(payments, students, courses)
        got = {r.id: (r.student_name, r.course_name) for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: ("Ann" if s else "N/A", "Maths" if c else "N/A") for i, s, c, _ in rows}


def test_required_fields_are_trimmed_of_all_white_space(spark):
    df = spark.createDataFrame([("\t\n",), (" x\n",)], "name string")
    assert [r.is_valid for r in Q.validate_rows(df, required=["name"]).collect()] == [False, True]


def test_format_currency_of_text_that_is_no_number(spark):
    df = spark.createDataFrame([("abc",), ("12.5",), (None,)], "v string")
    assert [r[0] for r in df.select(C.format_currency("v")).collect()] == ["$0.00", "$12.50", "$0.00"]
