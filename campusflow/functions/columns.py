"""Column expressions: compositions of built-in Spark functions, no Python UDFs.

Everything here returns a ``Column`` and stays inside whole-stage codegen
(or, for the array helpers, JVM-side higher-order functions).  Java regex
``\\w`` and ``\\s`` are ASCII, which is also what DuckDB's RE2 does.
"""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference for equal results) ----------------
# Validation patterns, used verbatim.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^[\+]?[1-9][\d]{0,15}$"
PHONE_STRIP = r"[\s\-\(\)]"
BLANK_ENDS = r"^\s+|\s+$"
# Slugs: what is dropped, what becomes a dash, which dashes go.
SLUG_DROPPED, SLUG_DASHES, SLUG_ENDS = r"[^\w\s-]", r"[\s-]+", r"^-+|-+$"
# Numbers in display text: what is dropped before reading one.
NOT_NUMERIC = r"[^\d.-]"
# Validation messages.
MSG_REQUIRED = " is required"
MSG_EMAIL = "Invalid email address"
MSG_PHONE = "Invalid phone number"
# Display defaults.
NOT_AVAILABLE = "N/A"
NO_DESCRIPTION = "No description available"
# File size units, steps of 1024.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]
# Start-date buckets: more than 7 days away, more than 0 days away, otherwise.
BUCKET_UPCOMING, BUCKET_SOON, BUCKET_STARTED = "Upcoming", "Starting Soon", "Started"
# Status labels: the stored value 'active' shows as Active, anything else as Inactive.
STATUS_ACTIVE, LABEL_ACTIVE, LABEL_INACTIVE = "active", "Active", "Inactive"
# --------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ts_lit(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(v, date):
        v = v.isoformat() + " 00:00:00"
    return F.to_timestamp(F.lit(str(v)))


def _date_lit(v) -> Column:
    if isinstance(v, Column):
        return F.to_date(v)
    if isinstance(v, datetime):
        v = v.date()
    return F.to_date(F.lit(str(v)[:10]))


# ---- defaults and labels ------------------------------------------------------------

def default_value(col, fallback) -> Column:
    """JS-style ``x || fallback``: NULL (and '' for text fallbacks) become ``fallback``."""
    c = _c(col)
    if isinstance(fallback, str):
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(fallback))
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(fallback))


def status_label(col) -> Column:
    """``active`` -> Active; anything else, NULL included, -> Inactive."""
    return F.when(_c(col) == STATUS_ACTIVE, F.lit(LABEL_ACTIVE)).otherwise(F.lit(LABEL_INACTIVE))


def days_until(start_col, as_of) -> Column:
    """ceil((start - as_of) / 1 day), start taken at UTC midnight."""
    start_ms = F.unix_millis(F.to_timestamp(_c(start_col)))
    return F.ceil((start_ms - F.unix_millis(_ts_lit(as_of))) / F.lit(86400000.0)).cast("int")


def course_start_bucket(start_col, as_of) -> Column:
    d = days_until(start_col, as_of)
    return (F.when(d > 7, F.lit(BUCKET_UPCOMING))
            .when(d > 0, F.lit(BUCKET_SOON))
            .otherwise(F.lit(BUCKET_STARTED)))


def admission_code(id_col, prefix: str = "STU", width: int = 6) -> Column:
    """``STU000123``; ids of more digits than ``width`` keep them all."""
    text = _c(id_col).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def to_int(col) -> Column:
    """PHP ``intval``: leading integer of the trimmed text, else 0."""
    lead = F.regexp_extract(F.trim(_c(col).cast("string")), r"^[+-]?\d+", 0)
    return F.coalesce(lead.try_cast("bigint"), F.lit(0).cast("bigint"))


# ---- text ---------------------------------------------------------------------------

def slugify(col) -> Column:
    s = F.regexp_replace(F.lower(_c(col)), SLUG_DROPPED, "")
    s = F.regexp_replace(s, SLUG_DASHES, "-")
    return F.regexp_replace(s, SLUG_ENDS, "")


def truncate(col, length: int = 50, suffix: str = "...") -> Column:
    c = _c(col)
    return F.when(F.length(c) <= length, c).otherwise(
        F.concat(F.substring(c, 1, length), F.lit(suffix)))


def capitalize(col) -> Column:
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def title_case(col) -> Column:
    """Upper-case the first word character of every whitespace-free run, lower the rest.

    Tokenises into whitespace / non-whitespace runs; inside a run the leading
    non-word characters are kept, so ``(foo)`` becomes ``(Foo)`` (``initcap``
    would leave it alone).
    """
    tokens = F.regexp_extract_all(_c(col), F.lit(r"(\s+|\S+)"), 1)

    def fix(t):
        prefix = F.regexp_extract(t, r"^(\W*)", 1)
        rest = F.substring(t, F.length(prefix) + 1, 2147483647)
        return F.concat(prefix, F.upper(F.substring(rest, 1, 1)),
                        F.lower(F.substring(rest, 2, 2147483647)))

    return F.when(_c(col).isNull(), F.lit(None).cast("string")).otherwise(
        F.array_join(F.transform(tokens, fix), ""))


def escape_html(col) -> Column:
    s = F.replace(_c(col), F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    return F.replace(s, F.lit(">"), F.lit("&gt;"))


def sanitize_text(col, keep_newlines: bool = False) -> Column:
    """Strip tags, drop control characters, collapse blanks, trim.

    ``keep_newlines`` is the textarea flavour: line breaks survive, other runs
    of blanks collapse to one space per line.
    """
    s = F.regexp_replace(F.regexp_replace(_c(col), r"<[^>]*>", ""), r"[\x00-\x08\x0E-\x1F\x7F]", "")
    if keep_newlines:
        s = F.regexp_replace(s, r"[\t\f\x0B ]+", " ")
        s = F.regexp_replace(s, r" *(\r\n|\r|\n) *", "\n")
    else:
        s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def sanitize_email(col) -> Column:
    """Trim, lower-case, drop characters an address cannot hold; '' if no ``x@y.z`` shape."""
    s = F.lower(F.trim(_c(col)))
    s = F.regexp_replace(s, r"[^a-z0-9.!#$%&'*+/=?^_`{|}~@-]", "")
    return F.when(s.rlike(r"^[^@]+@[^@]+\.[^@]+$"), s).otherwise(F.lit(""))


def mixed_sort_key(col) -> Column:
    """Numeric key of a display string (``$1,234.50`` -> 1234.5); NULL if not numeric."""
    cleaned = F.regexp_replace(_c(col), NOT_NUMERIC, "")
    lead = F.regexp_extract(cleaned, r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    return F.nullif(lead, F.lit("")).try_cast("double")


# ---- formats ------------------------------------------------------------------------

def format_currency(col, symbol: str = "$") -> Column:
    """``-$1,234.50``; rounding half-up to cents; NULL and text that is no number -> ``$0.00``."""
    v = F.round(_c(col).try_cast("decimal(38,4)"), 2)
    body = F.concat(F.lit(symbol), F.format_number(F.abs(v), 2))
    return (F.when(v.isNull(), F.lit(symbol + "0.00"))
            .when(v < 0, F.concat(F.lit("-"), body))
            .otherwise(body))


_DATE_TOKENS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss")]


def _java_pattern(fmt: str) -> str:
    out, i = [], 0
    literal = []
    while i < len(fmt):
        for tok, java in _DATE_TOKENS:
            if fmt.startswith(tok, i):
                if literal:
                    out.append("'" + "".join(literal).replace("'", "''") + "'")
                    literal = []
                out.append(java)
                i += len(tok)
                break
        else:
            literal.append(fmt[i])
            i += 1
    if literal:
        out.append("'" + "".join(literal).replace("'", "''") + "'")
    return "".join(out)


def format_date(col, fmt: str = "YYYY-MM-DD") -> Column:
    """Tokens YYYY MM DD HH mm ss; NULL -> ''."""
    return F.coalesce(F.date_format(_c(col), _java_pattern(fmt)), F.lit(""))


def format_date_short(col) -> Column:
    """``Jan 5, 2024``; NULL -> N/A."""
    return F.coalesce(F.date_format(_c(col), "MMM d, yyyy"), F.lit(NOT_AVAILABLE))


def parse_date(col, fmt: str = "YYYY-MM-DD") -> Column:
    """Split on ``/ - .`` and read the fields in the order the format names them.

    Invalid dates (month 13, day 32, letters) give NULL.
    """
    order = re.split(r"[/\-.]", fmt)
    parts = F.split(_c(col), r"[/\-.]")

    def field(tok):
        if tok not in order:
            return F.lit("1")
        return F.regexp_extract(F.get(parts, order.index(tok)), r"^\s*(\d+)", 1)

    iso = F.concat_ws("-", field("YYYY"), field("MM"), field("DD"))
    return F.try_to_date(iso, "y-M-d")


def format_file_size(col) -> Column:
    """Steps of 1024: ``0 Bytes``, ``1023 Bytes``, ``1.5 KB``, ``1 GB`` (max two decimals)."""
    b = _c(col).cast("bigint")

    def scaled(power):
        v = F.round(b.cast("double") / F.lit(float(1024 ** power)), 2).cast("string")
        return F.regexp_replace(v, r"\.0$", "")

    return (F.when(b.isNull(), F.lit(None).cast("string"))
            .when(b < 1024, F.concat(b.cast("string"), F.lit(" " + SIZE_UNITS[0])))
            .when(b < 1024 ** 2, F.concat(scaled(1), F.lit(" " + SIZE_UNITS[1])))
            .when(b < 1024 ** 3, F.concat(scaled(2), F.lit(" " + SIZE_UNITS[2])))
            .otherwise(F.concat(scaled(3), F.lit(" " + SIZE_UNITS[3]))))


# ---- URLs ---------------------------------------------------------------------------

def _query_pairs(url_col) -> Column:
    """Array of (pos, k, v, raw) structs of the query string, decoded, in order."""
    query = F.try_parse_url(_c(url_col), F.lit("QUERY"))
    raw = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")

    def to_pair(p, i):
        kv = F.split(p, "=", 2)
        k = F.get(kv, 0)
        v = F.coalesce(F.get(kv, 1), F.lit(""))
        return F.struct(i.alias("pos"),
                        F.coalesce(F.try_url_decode(k), k).alias("k"),
                        F.coalesce(F.try_url_decode(v), v).alias("v"),
                        p.alias("raw"))

    return F.transform(raw, to_pair)


def _last_per_key(pairs: Column) -> Column:
    keys = F.transform(pairs, lambda p: p["k"])
    n = F.size(keys)
    # keep pair i when no later pair carries the same key
    return F.filter(pairs, lambda p, i: (n - F.array_position(F.reverse(keys), p["k"])) == i)


def url_param_pairs(url_col) -> Column:
    """Query parameters as an array of (k, v) structs, one per key, the last duplicate winning."""
    return F.transform(_last_per_key(_query_pairs(url_col)),
                       lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))


def url_params(url_col) -> Column:
    """Query string -> MAP<STRING,STRING>; duplicates: last wins; values URL-decoded."""
    return F.map_from_entries(url_param_pairs(url_col))


def set_url_params(url_col, params: dict) -> Column:
    """Set the given parameters (first occurrence replaced, later ones dropped, absent ones
    appended) and delete those mapped to None.  Fragment and the rest of the URL are kept."""
    url = _c(url_col)
    pairs = _query_pairs(url)
    drop = [k for k, v in params.items() if v is None]
    sets = {k: str(v) for k, v in params.items() if v is not None}
    keys = F.transform(pairs, lambda p: p["k"])

    def keep(p, i):
        cond = F.lit(True)
        if drop:
            cond = ~p["k"].isin(drop)
        if sets:
            # a set key keeps only its first occurrence
            first = F.array_position(keys, p["k"]) == i + 1
            cond = cond & (~p["k"].isin(list(sets)) | first)
        return cond

    def render(p):
        out = p["raw"]
        for k, v in sets.items():
            out = F.when(p["k"] == k, F.lit(k + "=" + _form_encode(v))).otherwise(out)
        return out

    kept = F.transform(F.filter(pairs, keep), render)
    appended = [F.when(~F.array_contains(keys, F.lit(k)), F.lit(k + "=" + _form_encode(v)))
                for k, v in sets.items()]
    all_parts = F.concat(kept, F.array_compact(F.array(*appended))) if appended else kept
    query = F.array_join(all_parts, "&")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(url.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(base, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)), frag))


def _form_encode(v: str) -> str:
    from urllib.parse import quote_plus
    return quote_plus(v)


def strip_tracking_params(url_col, prefix: str = "utm_") -> Column:
    """Canonical URL: every parameter whose name starts with ``prefix`` removed."""
    url = _c(url_col)
    pairs = _query_pairs(url)
    kept = F.transform(F.filter(pairs, lambda p: ~p["k"].startswith(prefix)), lambda p: p["raw"])
    query = F.array_join(kept, "&")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(url.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(base, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)), frag))


# ---- validation ---------------------------------------------------------------------

def validation_errors(required=(), email=(), phone=()) -> Column:
    """ARRAY<STRING> of messages, per column in the order required / email / phone.

    Email and phone rules apply to non-blank values only, like the reference.
    """
    cols = list(dict.fromkeys(list(required) + list(email) + list(phone)))
    checks = []
    for name in cols:
        v = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), BLANK_ENDS, "")
        if name in required:
            checks.append(F.when(v == "", F.lit(name + MSG_REQUIRED)))
        if name in email:
            checks.append(F.when((v != "") & ~v.rlike(EMAIL_PATTERN), F.lit(MSG_EMAIL)))
        if name in phone:
            stripped = F.regexp_replace(v, PHONE_STRIP, "")
            checks.append(F.when((v != "") & ~stripped.rlike(PHONE_PATTERN), F.lit(MSG_PHONE)))
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))
