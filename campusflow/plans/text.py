"""Registered data-quality, text-cleaning, formatting and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from campusflow.functions import columns as C
from campusflow.operators import quality as Q
from campusflow.operators import text_jobs as TJ
from campusflow.plans.registry import query
from campusflow.sources.adapters import Academy

# Contact fields in document text: every e-mail-like and every phone-like run.
_EMAIL_RUN = r"[^\s]*@[^\s]*"
_PHONE_RUN = r"\+?[0-9][0-9 ()-]{6,}[0-9]"


def _contacts(spark, sf_dir):
    """One row per contact of a document, the n-th e-mail beside the n-th phone; one empty row without any."""
    d = Academy(spark, sf_dir).text("documents", "doc_id", "source", "text")
    runs = d.select("doc_id", "source", F.arrays_zip(
        F.regexp_extract_all("text", F.lit(_EMAIL_RUN), F.lit(0)).alias("email"),
        F.regexp_extract_all("text", F.lit(_PHONE_RUN), F.lit(0)).alias("phone")).alias("runs"))
    return runs.select("doc_id", "source", F.posexplode_outer("runs").alias("pos", "run")).select(
        "doc_id", "source", (F.coalesce("pos", F.lit(0)) + 1).cast("bigint").alias("position"),
        F.col("run.email").alias("email"), F.col("run.phone").alias("phone"))


_TRIM = "regexp_replace(coalesce({}, ''), '^\\s+|\\s+$', '', 'g')"
_CONTACTS_SQL = f"""
contacts AS (
  SELECT doc_id, source, i AS position, emails[i] AS email, phones[i] AS phone FROM (
    SELECT *, unnest(range(1, greatest(len(emails), len(phones), 1) + 1)) AS i FROM (
      SELECT doc_id, source, regexp_extract_all(text, '{_EMAIL_RUN}') AS emails,
             regexp_extract_all(text, '{_PHONE_RUN}') AS phones FROM documents))),
checked AS (
  SELECT *, list_filter([
      CASE WHEN s = '' THEN 'source is required' END,
      CASE WHEN e = '' THEN 'email is required' END,
      CASE WHEN e <> '' AND NOT regexp_full_match(e, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')
           THEN 'Invalid email address' END,
      CASE WHEN p <> '' AND NOT regexp_full_match(regexp_replace(p, '[\\s\\-\\(\\)]', '', 'g'),
                                                  '[\\+]?[1-9][\\d]{{0,15}}')
           THEN 'Invalid phone number' END], lambda x: x IS NOT NULL) AS errors
  FROM (SELECT *, {_TRIM.format('source')} AS s, {_TRIM.format('email')} AS e, {_TRIM.format('phone')} AS p
        FROM contacts))
"""


def _validated(spark, sf_dir):
    return Q.validate_rows(_contacts(spark, sf_dir), required=["source", "email"], email=["email"],
                           phone=["phone"])


@query("validate_rows", f"""
WITH {_CONTACTS_SQL}
SELECT doc_id, position, email, phone, len(errors) = 0 AS is_valid, len(errors) AS n_errors,
       array_to_string(errors, '; ') AS error_text
FROM checked
""")
def q_validate_rows(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("doc_id", "position", "email", "phone", "is_valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join("errors", "; ").alias("error_text"))


@query("split_valid", f"""
WITH {_CONTACTS_SQL}
SELECT doc_id, position, email, phone, CASE WHEN len(errors) = 0 THEN 'good' ELSE 'rejected' END AS side,
       array_to_string(errors, '; ') AS error_text
FROM checked
""")
def q_split_valid(spark, sf_dir):
    """Both sides of the split, each row marked with its side."""
    good, bad = Q.split_valid(_validated(spark, sf_dir))
    cols = ["doc_id", "position", "email", "phone"]
    return (good.select(*cols, F.lit("good").alias("side"), F.lit("").alias("error_text"))
            .unionByName(bad.select(*cols, F.lit("rejected").alias("side"),
                                    F.array_join("errors", "; ").alias("error_text"))))


@query("quality_report", f"""
WITH {_CONTACTS_SQL}
SELECT error, count(*) AS failures FROM (SELECT unnest(errors) AS error FROM checked) GROUP BY error
""")
def q_quality_report(spark, sf_dir):
    return Q.quality_report(_validated(spark, sf_dir))


@query("clean_documents", """
SELECT doc_id,
       md5(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS text_clean_md5,
       md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\w\\s-]', '', 'g'),
                                         '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS text_slug_md5,
       md5(upper(substring(text, 1, 1)) || lower(substring(text, 2))) AS text_capitalized_md5,
       CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 50) || '...' END AS text_preview,
       md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_html_md5,
       length(text) AS n_chars
FROM documents
""")
def q_clean_documents(spark, sf_dir):
    """Whole-text cleaning of every document; long outputs compared by digest."""
    d = Academy(spark, sf_dir).text("documents", "doc_id", "text")
    t = TJ.clean_text_columns(d, ["text"], keep=("doc_id", "text"))
    return t.select("doc_id", F.md5("text_clean").alias("text_clean_md5"),
                    F.md5("text_slug").alias("text_slug_md5"),
                    F.md5("text_capitalized").alias("text_capitalized_md5"),
                    "text_preview", F.md5("text_html").alias("text_html_md5"),
                    F.length("text").cast("bigint").alias("n_chars"))


_TITLE_SQL = """list_aggregate(list_transform(regexp_extract_all({c}, '(\\s+|\\S+)', 1),
    lambda t: regexp_extract(t, '^(\\W*)', 1)
         || upper(substring(t, length(regexp_extract(t, '^(\\W*)', 1)) + 1, 1))
         || lower(substring(t, length(regexp_extract(t, '^(\\W*)', 1)) + 2))), 'string_agg', '')"""


@query("title_case_conversations", f"""
SELECT conv_id, turn, role, coalesce({_TITLE_SQL.format(c='text')}, '') AS text_title,
       regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\\w\\s-]', '', 'g'),
                                     '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g') AS text_slug
FROM conversations
""")
def q_title_case_conversations(spark, sf_dir):
    c = Academy(spark, sf_dir).text("conversations", "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", "role", C.title_case("text").alias("text_title"),
                    C.slugify("text").alias("text_slug"))


@query("format_report_columns", """
SELECT id,
       CASE WHEN amount < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(round(amount, 2))::DOUBLE)
         AS amount_display,
       strftime(payment_date, '%d/%m/%Y') AS payment_date_display,
       strftime(payment_date, '%b %-d, %Y') AS payment_date_short
FROM payments
""")
def q_format_report_columns(spark, sf_dir):
    p = Academy(spark, sf_dir).payments
    return TJ.format_report_columns(p, money=["amount"], dates=["payment_date"], keep=["id"],
                                    date_format="DD/MM/YYYY")


@query("format_file_size", """
SELECT id, file_size,
       CASE WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) || ' Bytes'
            WHEN file_size < 1048576
              THEN regexp_replace(CAST(round(file_size / 1024.0, 2) AS VARCHAR), '\\.0$', '') || ' KB'
            WHEN file_size < 1073741824
              THEN regexp_replace(CAST(round(file_size / 1048576.0, 2) AS VARCHAR), '\\.0$', '') || ' MB'
            ELSE regexp_replace(CAST(round(file_size / 1073741824.0, 2) AS VARCHAR), '\\.0$', '') || ' GB'
       END AS file_size_display
FROM screenshots
""")
def q_format_file_size(spark, sf_dir):
    s = Academy(spark, sf_dir).screenshots
    return TJ.format_report_columns(s, sizes=["file_size"], keep=["id", "file_size"])


@query("parse_date", """
SELECT id, s,
       try_strptime(split_part(s, '/', 3) || '-' || split_part(s, '/', 2) || '-' || split_part(s, '/', 1),
                    '%Y-%m-%d')::DATE AS parsed_dmy,
       try_strptime(split_part(s, '/', 3) || '-' || split_part(s, '/', 1) || '-' || split_part(s, '/', 2),
                    '%Y-%m-%d')::DATE AS parsed_mdy
FROM (SELECT id, strftime(payment_date, '%d/%m/%Y') AS s FROM payments)
""")
def q_parse_date(spark, sf_dir):
    """Round trip of printed dates; read as MM/DD/YYYY, days past 12 become NULL."""
    p = Academy(spark, sf_dir).payments.select("id", C.format_date("payment_date", "DD/MM/YYYY").alias("s"))
    return p.select("id", "s", C.parse_date("s", "DD/MM/YYYY").alias("parsed_dmy"),
                    C.parse_date("s", "MM/DD/YYYY").alias("parsed_mdy"))


_PAIRS_SQL = """
pairs AS (
  SELECT page_id, pos, raw,
         coalesce(url_decode(replace(split_part(raw, '=', 1), '+', ' ')), split_part(raw, '=', 1)) AS k,
         coalesce(url_decode(replace(CASE WHEN position('=' IN raw) > 0
                                          THEN substring(raw, position('=' IN raw) + 1) ELSE '' END,
                                     '+', ' ')), '') AS v
  FROM (SELECT page_id, unnest(q) AS raw, generate_subscripts(q, 1) AS pos
        FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
                                          lambda x: x <> '') AS q FROM pages))),
last_pairs AS (
  SELECT page_id, k AS param, v AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY pos DESC) AS rn FROM pairs)
  WHERE rn = 1)
"""


@query("url_params", f"WITH {_PAIRS_SQL} SELECT page_id, param, value FROM last_pairs")
def q_url_params(spark, sf_dir):
    return TJ.url_param_rows(Academy(spark, sf_dir).raw("pages"))


@query("url_attribution", f"""
WITH {_PAIRS_SQL} SELECT param, value, count(*) AS pages FROM last_pairs GROUP BY param, value
""")
def q_url_attribution(spark, sf_dir):
    return TJ.url_attribution(Academy(spark, sf_dir).raw("pages"))


@query("canonical_urls", """
SELECT page_id, url,
       regexp_extract(url, '^([^?#]*)', 1)
       || CASE WHEN q = '' THEN '' ELSE '?' || q END
       || regexp_extract(url, '(#.*)$', 1) AS canonical_url
FROM (SELECT page_id, url,
             array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
                                         lambda x: x <> '' AND NOT starts_with(
                                           coalesce(url_decode(replace(split_part(x, '=', 1), '+', ' ')),
                                                    split_part(x, '=', 1)), 'utm_')), '&') AS q
      FROM pages)
""")
def q_canonical_urls(spark, sf_dir):
    return TJ.canonical_urls(Academy(spark, sf_dir).raw("pages"))


@query("set_url_params", """
SELECT page_id,
       regexp_extract(url, '^([^?#]*)', 1) || '?' ||
       array_to_string(list_concat(
         list_transform(
           list_filter(q, lambda x, i: split_part(x, '=', 1) <> 'ref'
                                       AND (split_part(x, '=', 1) <> 'page' OR list_position(k, 'page') = i)),
           lambda x: CASE WHEN split_part(x, '=', 1) = 'page' THEN 'page=1' ELSE x END),
         CASE WHEN list_contains(k, 'page') THEN [] ELSE ['page=1'] END), '&')
       || regexp_extract(url, '(#.*)$', 1) AS new_url
FROM (SELECT *, list_transform(q, lambda x: split_part(x, '=', 1)) AS k
      FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
                                             lambda x: x <> '') AS q FROM pages))
""")
def q_set_url_params(spark, sf_dir):
    """Reset paging on every page URL: page=1 in place of the first page parameter, or appended; ref dropped."""
    p = Academy(spark, sf_dir).raw("pages")
    return p.select("page_id", C.set_url_params("url", {"page": 1, "ref": None}).alias("new_url"))


@query("admission_code", """
SELECT c_custkey AS id, 'STU' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(length(CAST(c_custkey AS VARCHAR)), 6) AS INTEGER), '0') AS code,
       upper(substring(lower(c_mktsegment), 1, 1)) || lower(substring(lower(c_mktsegment), 2)) AS segment
FROM customer
""")
def q_admission_code(spark, sf_dir):
    c = Academy(spark, sf_dir).raw("customer")
    return c.select(F.col("c_custkey").alias("id"), C.admission_code("c_custkey").alias("code"),
                    C.capitalize(F.lower("c_mktsegment")).alias("segment"))


@query("sanitize_emails", f"""
SELECT doc_id, position, email,
       CASE WHEN regexp_matches(e, '^[^@]+@[^@]+\\.[^@]+$') THEN e ELSE '' END AS email_clean
FROM (SELECT doc_id, i AS position, emails[i] AS email,
             regexp_replace(lower(trim(emails[i])), '[^a-z0-9.!#$%&''*+/=?^_`{{|}}~@-]', '', 'g') AS e
      FROM (SELECT *, unnest(range(1, len(emails) + 1)) AS i FROM (
              SELECT doc_id, regexp_extract_all(text, '{_EMAIL_RUN}') AS emails FROM documents)))
""")
def q_sanitize_emails(spark, sf_dir):
    c = _contacts(spark, sf_dir).filter(F.col("email").isNotNull())
    return c.select("doc_id", "position", "email", C.sanitize_email("email").alias("email_clean"))


@query("search_documents", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE contains(lower(concat_ws(chr(10), text, lang, source)), 'example.com')
""")
def q_search_documents(spark, sf_dir):
    """Whole-text search over every document (literal, case-insensitive)."""
    from campusflow.operators.search import search_rows
    d = Academy(spark, sf_dir).text("documents", "doc_id", "text", "lang", "source", "n_chars")
    return search_rows(d, "Example.COM", ["text", "lang", "source"]).select("doc_id", "lang", "source",
                                                                            "n_chars")
