"""DuckDB twins of the registered queries (the correctness oracle).

``CANONICAL_CTES`` re-states ``campusflow.sources.adapters`` in DuckDB SQL
over the pre-registered test views; every oracle query is prefixed with it.
Sums of money are cast to DECIMAL(38,2) and means are DOUBLE divisions of
exact sums, so both engines produce the same values bit for bit.
"""

from __future__ import annotations

CANONICAL_CTES = """
students AS (
  SELECT c_custkey AS id,
         'STU' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 6) AS INTEGER), '0') AS student_id,
         c_name AS name,
         lower(replace(c_name, '#', '.')) || '@example.edu' AS email,
         '+1 555 ' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phone,
         'Nation ' || CAST(c_nationkey AS VARCHAR) AS address,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 200 END AS course_id,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS admission_date,
         CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status,
         CAST(NULL AS VARCHAR) AS profile_image,
         c_mktsegment AS notes,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP)
           + to_seconds(CAST(c_custkey % 86400 AS BIGINT)) AS created_at
  FROM customer),
courses AS (
  SELECT p_partkey AS id, p_brand AS course_code, p_name AS course_name,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || ' - ' || p_type END AS description,
         p_type AS instructor, p_size AS duration_weeks,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST(DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '2024-01-01' + CAST(p_partkey % 60 + p_size * 7 AS INTEGER) AS DATE) AS end_date,
         CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS status,
         'https://academy.example.edu/syllabus/' || CAST(p_partkey AS VARCHAR)
           || '?utm_source=catalog&v=1' AS syllabus_url,
         CAST(NULL AS VARCHAR) AS thumbnail,
         TIMESTAMP '2023-12-01 00:00:00' + to_seconds(CAST(p_partkey % 86400 AS BIGINT)) AS created_at
  FROM part),
enrollments AS (
  SELECT l_orderkey * 100 + l_linenumber AS id, o_custkey AS student_id, l_partkey AS course_id,
         CAST(l_shipdate AS DATE) AS enrollment_date,
         CASE WHEN l_linestatus = 'F'
              THEN CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS DATE) END
           AS completion_date,
         CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'completed' END AS status,
         CAST(l_quantity * 2 AS DECIMAL(5,2)) AS progress,
         l_returnflag AS grade,
         CASE WHEN l_returnflag = 'A' THEN 'https://academy.example.edu/cert/'
              || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END
           AS certificate_url
  FROM lineitem LEFT JOIN (SELECT o_orderkey, max(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey) o
    ON l_orderkey = o.o_orderkey),
payments AS (
  SELECT o_orderkey AS id, o_custkey AS student_id, fl.first_partkey AS course_id,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CAST(o_orderdate AS DATE) AS payment_date,
         o_orderpriority AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'overdue' END
           AS payment_status,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'REF' || CAST(o_orderkey AS VARCHAR) END
           AS reference_number,
         CAST(NULL AS VARCHAR) AS notes
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_partkey
                         FROM lineitem GROUP BY l_orderkey) fl
    ON o_orderkey = fl.l_orderkey),
setting_changes AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS setting_key, props AS setting_value,
         ts AS changed_at, event_id AS seq
  FROM events),
audit_log AS (
  SELECT event_id AS id, ts AS "timestamp", user_id, event_type AS action,
         'academy' AS plugin, '1.0.0' AS version
  FROM events),
screenshots AS (
  SELECT page_id AS id, page_id % 1500 AS student_id,
         CASE WHEN page_id % 2 = 0 THEN 'face' ELSE 'work' END AS screenshot_type,
         url AS file_path, CAST(strlen(html) AS BIGINT) AS file_size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 37 % 43200 AS BIGINT)) AS upload_date,
         CASE page_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'rejected' END
           AS verification_status,
         CAST(NULL AS VARCHAR) AS description
  FROM pages)
"""


def with_canonical(sql: str) -> str:
    """Prefix a query over the canonical tables with their CTE definitions."""
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + CANONICAL_CTES.strip() + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + CANONICAL_CTES.strip() + ",\n" + body[4:].lstrip()
    return "WITH " + CANONICAL_CTES.strip() + "\n" + body
