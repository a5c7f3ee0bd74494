"""Hand-made edge rows (FIXTURES.md section 3) for the column expressions."""

from decimal import Decimal

from pyspark.sql import functions as F

from campusflow.functions import columns as C


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_status_label(spark):
    assert one_col(spark, ["active", "Active", None, ""], C.status_label) == \
        ["Active", "Inactive", "Inactive", "Inactive"]


def test_start_bucket(spark):
    as_of = "2024-01-01 06:00:00"
    got = one_col(spark, ["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09"],
                  lambda c: C.course_start_bucket(F.to_date(c), as_of))
    assert got == ["Started", "Starting Soon", "Starting Soon", "Upcoming"]
    days = one_col(spark, ["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09"],
                   lambda c: C.days_until(F.to_date(c), as_of))
    assert days == [0, 1, 7, 8]


def test_default_value(spark):
    assert one_col(spark, ["x", "", None], lambda c: C.default_value(c, "N/A")) == ["x", "N/A", "N/A"]


def test_validation(spark):
    rows = [("a@b.co", "+1 (555) 010-2000"), ("a@b", "0123"), ("a b@c.de", "12ab"), ("", "")]
    df = spark.createDataFrame(rows, "email string, phone string")
    got = df.select(C.validation_errors(email=["email"], phone=["phone"]).alias("e")).collect()
    assert [r.e for r in got] == [[], ["Invalid email address", "Invalid phone number"],
                                  ["Invalid email address", "Invalid phone number"], []]
    req = df.select(C.validation_errors(required=["email"], email=["email"]).alias("e")).collect()
    assert req[3].e == ["email is required"]


def test_slugify(spark):
    assert one_col(spark, [" Héllo,  World -- x "], C.slugify) == ["hllo-world-x"]


def test_title_case_and_capitalize(spark):
    assert one_col(spark, ["hello o'neil (foo) bar-BAZ"], C.title_case) == ["Hello O'neil (Foo) Bar-baz"]
    assert one_col(spark, ["  two  spaces\tTAB"], C.title_case) == ["  Two  Spaces\tTab"]
    assert one_col(spark, ["hELLO wORLD"], C.capitalize) == ["Hello world"]


def test_truncate(spark):
    assert one_col(spark, ["abcdef", "abc"], lambda c: C.truncate(c, 3)) == ["abc...", "abc"]
    assert one_col(spark, ["abcdef"], lambda c: C.truncate(c, 4)) == ["abcd..."]


def test_format_currency(spark):
    got = one_col(spark, [Decimal("2.345"), Decimal("-1234.5"), None], C.format_currency, "decimal(10,3)")
    assert got == ["$2.35", "-$1,234.50", "$0.00"]


def test_format_file_size(spark):
    got = one_col(spark, [0, 1023, 1536, 1073741824, 5 * 1024 ** 4], C.format_file_size, "bigint")
    assert got == ["0 Bytes", "1023 Bytes", "1.5 KB", "1 GB", "5120 GB"]


def test_format_and_parse_dates(spark):
    assert one_col(spark, ["2024-01-05"], lambda c: C.format_date_short(F.to_date(c))) == ["Jan 5, 2024"]
    assert one_col(spark, [None], lambda c: C.format_date_short(F.to_date(c))) == ["N/A"]
    assert one_col(spark, ["2024-01-05"], lambda c: C.format_date(F.to_date(c), "DD/MM/YYYY")) == ["05/01/2024"]
    assert one_col(spark, [None], lambda c: C.format_date(F.to_date(c))) == [""]
    got = one_col(spark, ["05/01/2024", "31/13/2024", "x"], lambda c: C.parse_date(c, "DD/MM/YYYY"))
    assert [str(x) if x else None for x in got] == ["2024-01-05", None, None]


def test_url_params(spark):
    df = spark.createDataFrame([("https://x.example/p?page=2&ref=x&page=3#top",),
                                ("https://x.example/p",), ("https://x.example/p?q=a%20b+c&flag",)], "url string")
    got = [r.m for r in df.select(C.url_params("url").alias("m")).collect()]
    assert got[0] == {"page": "3", "ref": "x"}
    assert got[1] == {}
    assert got[2] == {"q": "a b c", "flag": ""}


def test_set_url_params(spark):
    df = spark.createDataFrame([("https://x.example/p?page=2&ref=x&page=3#top",), ("https://x.example/p",)],
                               "url string")
    got = [r.u for r in df.select(C.set_url_params("url", {"page": 1, "ref": None, "lang": "en"})
                                  .alias("u")).collect()]
    assert got == ["https://x.example/p?page=1&lang=en#top", "https://x.example/p?page=1&lang=en"]
    strip = [r.u for r in df.select(C.strip_tracking_params("url", "re").alias("u")).collect()]
    assert strip[0] == "https://x.example/p?page=2&page=3#top"


def test_mixed_sort(spark):
    from campusflow.operators.search import sort_mixed
    df = spark.createDataFrame([(1, "$1,234.50"), (2, "9"), (3, "N/A"), (4, "-2")], "id int, s string")
    assert [r.s for r in sort_mixed(df, "s").collect()] == ["-2", "9", "$1,234.50", "N/A"]


def test_sanitize_and_intval(spark):
    assert one_col(spark, ["  <b>Ann</b>\n  Lee  "], C.sanitize_text) == ["Ann Lee"]
    assert one_col(spark, ["A\x00n\x1bn\x7f\tL\x0bee"], C.sanitize_text) == ["Ann L ee"]
    assert one_col(spark, [" Ann@Example.COM "], C.sanitize_email) == ["ann@example.com"]
    assert one_col(spark, ["not mail"], C.sanitize_email) == [""]
    assert one_col(spark, ["12abc", " 7 ", "x", None], C.to_int) == [12, 7, 0, 0]
    assert one_col(spark, ["a & <b>"], C.escape_html) == ["a &amp; &lt;b&gt;"]
