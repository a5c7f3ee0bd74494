"""The three table jobs built from the column expressions of ``functions.columns``.

* ``clean_text_columns``  - sanitise / slug / case / truncate / escape text columns
* ``format_report_columns`` - printable money, dates and sizes for export
* ``url_attribution``  - query parameters per page, pages per parameter, canonical URLs
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.functions import columns as C


def clean_text_columns(df: DataFrame, cols, keep: tuple = (), truncate_at: int = 50) -> DataFrame:
    """For every text column ``c``: ``c_clean`` (sanitised), ``c_slug``, ``c_title``,
    ``c_capitalized``, ``c_preview`` (truncated display copy) and ``c_html`` (escaped)."""
    out = [F.col(k) for k in keep]
    for c in cols:
        out += [
            C.sanitize_text(c).alias(f"{c}_clean"),
            C.slugify(c).alias(f"{c}_slug"),
            C.title_case(c).alias(f"{c}_title"),
            C.capitalize(c).alias(f"{c}_capitalized"),
            C.truncate(c, truncate_at).alias(f"{c}_preview"),
            C.escape_html(c).alias(f"{c}_html"),
        ]
    return df.select(*out)


def format_report_columns(df: DataFrame, money=(), dates=(), sizes=(), keep=(),
                          date_format: str = "YYYY-MM-DD", symbol: str = "$") -> DataFrame:
    out = [F.col(k) for k in keep]
    out += [C.format_currency(c, symbol).alias(f"{c}_display") for c in money]
    for c in dates:
        out += [C.format_date(c, date_format).alias(f"{c}_display"),
                C.format_date_short(c).alias(f"{c}_short")]
    out += [C.format_file_size(c).alias(f"{c}_display") for c in sizes]
    return df.select(*out)


def url_param_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per (page, parameter): the decoded value, the last duplicate winning."""
    return (pages.select(id_col, F.explode(C.url_param_pairs(url_col)).alias("p"))
            .select(id_col, F.col("p.k").alias("param"), F.col("p.v").alias("value")))


def url_attribution(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Pages per (parameter, value)."""
    return (url_param_rows(pages, id_col, url_col).groupBy("param", "value")
            .agg(F.count(F.lit(1)).alias("pages")))


def canonical_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   prefix: str = "utm_") -> DataFrame:
    return pages.select(id_col, url_col, C.strip_tracking_params(url_col, prefix).alias("canonical_url"))
