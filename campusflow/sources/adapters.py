"""Map the driver's TPC-H-style test tables onto the canonical academy tables.

Each adapter is a lazy projection (plus, for enrollments and payments, one
equi-join on the order key), so Catalyst prunes every column a query does not
use.  The same mappings exist as DuckDB CTEs in ``campusflow.plans.oracle``;
keep the two in step.

students    <- customer            courses  <- part
enrollments <- lineitem JOIN orders          payments <- orders LEFT JOIN lines per order
settings changes, audit log <- events        urls / files <- pages
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.operators.layout import spread
from campusflow.sources.tables import read_test_table


class Academy:
    """Lazily built canonical tables over one test-data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_test_table(self.spark, self.sf_dir, name)

    def text(self, name: str, *cols: str) -> DataFrame:
        """A text table pruned to ``cols`` and spread over the cores for regex-heavy work."""
        df = self.raw(name)
        return spread(df.select(*cols) if cols else df)

    @property
    def students(self) -> DataFrame:
        return students_from_customer(self.raw("customer"))

    @property
    def courses(self) -> DataFrame:
        return courses_from_part(self.raw("part"))

    @property
    def enrollments(self) -> DataFrame:
        return enrollments_from_lines(self.raw("lineitem"), self.raw("orders"))

    @property
    def payments(self) -> DataFrame:
        return payments_from_orders(self.raw("orders"), self.raw("lineitem"))

    @property
    def setting_changes(self) -> DataFrame:
        return setting_changes_from_events(self.raw("events"))

    @property
    def audit_log(self) -> DataFrame:
        return audit_from_events(self.raw("events"))

    @property
    def screenshots(self) -> DataFrame:
        return screenshots_from_pages(self.raw("pages"))


def students_from_customer(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "concat('STU', lpad(CAST(c_custkey AS STRING), greatest(length(CAST(c_custkey AS STRING)), 6), '0')) AS student_id",
        "c_name AS name",
        "concat(lower(replace(c_name, '#', '.')), '@example.edu') AS email",
        "concat('+1 555 ', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0')) AS phone",
        "concat('Nation ', CAST(c_nationkey AS STRING)) AS address",
        "CASE WHEN c_custkey % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey % 200 END AS course_id",
        "date_add(DATE'2024-01-01', CAST(c_custkey % 365 AS INT)) AS admission_date",
        "CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status",
        "CAST(NULL AS STRING) AS profile_image",
        "c_mktsegment AS notes",
        "timestampadd(SECOND, CAST(c_custkey % 86400 AS INT),"
        " CAST(date_add(DATE'2024-01-01', CAST(c_custkey % 365 AS INT)) AS TIMESTAMP)) AS created_at",
    )


def courses_from_part(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS id",
        "p_brand AS course_code",
        "p_name AS course_name",
        "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(p_name, ' - ', p_type) END AS description",
        "p_type AS instructor",
        "p_size AS duration_weeks",
        "CAST(p_retailprice AS DECIMAL(10,2)) AS price",
        "date_add(DATE'2024-01-01', CAST(p_partkey % 60 AS INT)) AS start_date",
        "date_add(DATE'2024-01-01', CAST(p_partkey % 60 + p_size * 7 AS INT)) AS end_date",
        "CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS status",
        "concat('https://academy.example.edu/syllabus/', CAST(p_partkey AS STRING),"
        " '?utm_source=catalog&v=1') AS syllabus_url",
        "CAST(NULL AS STRING) AS thumbnail",
        "timestampadd(SECOND, CAST(p_partkey % 86400 AS INT), TIMESTAMP'2023-12-01 00:00:00') AS created_at",
    )


def enrollments_from_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One enrollment per order line: the order's customer takes the line's part.

    The order side is reduced to one row per order key and left-joined, so
    Catalyst drops the join (and the orders scan) whenever a query does not
    use ``student_id``, as in course- and date-level aggregates.
    ``id`` is ``l_orderkey * 100 + l_linenumber``; it is not unique in the test
    data (order lines repeat), so ordered outputs break ties on every column.
    """
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                            "l_linestatus", "l_returnflag", "l_shipdate")
    o = orders.groupBy("o_orderkey").agg(F.max("o_custkey").alias("o_custkey"))
    return lines.join(o, lines.l_orderkey == o.o_orderkey, "left").selectExpr(
        "l_orderkey * 100 + l_linenumber AS id",
        "o_custkey AS student_id",
        "l_partkey AS course_id",
        "CAST(l_shipdate AS DATE) AS enrollment_date",
        "CASE WHEN l_linestatus = 'F' THEN date_add(CAST(l_shipdate AS DATE), CAST(l_quantity AS INT))"
        " END AS completion_date",
        "CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'completed' END AS status",
        "CAST(l_quantity * 2 AS DECIMAL(5,2)) AS progress",
        "l_returnflag AS grade",
        "CASE WHEN l_returnflag = 'A' THEN concat('https://academy.example.edu/cert/',"
        " CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS certificate_url",
    )


def payments_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One payment per order; its course is the smallest part key on the order.

    The per-order aggregate is partial-aggregated map-side and hash-partitioned
    on the order key, so the left join only shuffles ``orders``.
    """
    first_course = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_partkey"))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                      "o_orderpriority", "o_orderstatus")
    return o.join(first_course, o.o_orderkey == first_course.l_orderkey, "left").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS student_id",
        "first_partkey AS course_id",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS amount",
        "CAST(o_orderdate AS DATE) AS payment_date",
        "o_orderpriority AS payment_method",
        "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END"
        " AS payment_status",
        "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING)"
        " ELSE concat('REF', CAST(o_orderkey AS STRING)) END AS reference_number",
        "CAST(NULL AS STRING) AS notes",
    )


def setting_changes_from_events(events: DataFrame) -> DataFrame:
    """Key/value change feed: key ``user_id:event_type``, value ``props``; ``seq`` breaks ties."""
    return events.selectExpr(
        "concat(CAST(user_id AS STRING), ':', event_type) AS setting_key",
        "props AS setting_value",
        "CAST(ts AS TIMESTAMP) AS changed_at",
        "event_id AS seq",
    )


def audit_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS id",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "user_id",
        "event_type AS action",
        "'academy' AS plugin",
        "'1.0.0' AS version",
    )


def screenshots_from_pages(pages: DataFrame) -> DataFrame:
    """An uploaded file per page: its URL is the path, the HTML length its size."""
    return pages.selectExpr(
        "page_id AS id",
        "page_id % 1500 AS student_id",
        "CASE WHEN page_id % 2 = 0 THEN 'face' ELSE 'work' END AS screenshot_type",
        "url AS file_path",
        "CAST(octet_length(html) AS BIGINT) AS file_size",
        "timestampadd(MINUTE, CAST(page_id * 37 % 43200 AS INT), TIMESTAMP'2024-01-01 00:00:00')"
        " AS upload_date",
        "CASE page_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'rejected' END"
        " AS verification_status",
        "CAST(NULL AS STRING) AS description",
    )
