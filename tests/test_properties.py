"""Randomised checks: the Spark column expressions against plain-Python statements of the same
rules, over a few hundred generated strings evaluated in one query each."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from campusflow.functions import columns as C

ALPHABET = list("abcXYZ019 _-,.'()&<>@+%#$\t") + ["é", "Ä", "ß", " ", "\n", "--", "  "]


def strings(seed, n=400, max_len=24):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


def spark_map(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


# plain-Python statements of the rules (ASCII \w and \s, like Java and RE2); patterns are the fixed values
def py_slugify(s):
    s = re.sub(C.SLUG_DROPPED, "", s.lower(), flags=re.ASCII)
    s = re.sub(C.SLUG_DASHES, "-", s, flags=re.ASCII)
    return re.sub(C.SLUG_ENDS, "", s)


def py_title(s):
    return re.sub(r"\w\S*", lambda m: m[0][0].upper() + m[0][1:].lower(), s, flags=re.ASCII)


def py_capitalize(s):
    return s[:1].upper() + s[1:].lower()


def py_size(b):
    """JS ``parseFloat((b / 1024**i).toFixed(2))``: half-up on the exact quotient."""
    if b < 1024:
        return f"{b} Bytes"
    for i, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        if b < 1024 ** (i + 1) or unit == "GB":
            v = (Decimal(b) / Decimal(1024 ** i)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
            return f"{format(v.normalize(), 'f')} {unit}"


def py_params(url):
    q = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    out = {}
    for p in q.split("&"):
        if not p:
            continue
        k, _, v = p.partition("=")
        out[unquote_plus(k)] = unquote_plus(v)
    return out


@pytest.mark.parametrize("name,spark_fn,py_fn", [
    ("slugify", C.slugify, py_slugify),
    ("title_case", C.title_case, py_title),
    ("capitalize", C.capitalize, py_capitalize),
    ("truncate", lambda c: C.truncate(c, 7), lambda s: s if len(s) <= 7 else s[:7] + "..."),
    ("escape_html", C.escape_html, lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")),
])
def test_text_rules(spark, name, spark_fn, py_fn):
    values = strings(sum(map(ord, name)))
    assert spark_map(spark, values, spark_fn) == [py_fn(v) for v in values]


def test_file_size_rule(spark):
    rnd = random.Random(7)
    values = [0, 1, 1023, 1024, 1025, 1536, 1048575, 1048576, 1073741823, 1073741824, 5 * 1024 ** 4]
    values += [rnd.randint(0, 1 << rnd.randint(1, 42)) for _ in range(400)]
    assert spark_map(spark, values, C.format_file_size, "bigint") == [py_size(v) for v in values]


def test_validation_rules(spark):
    email_re = re.compile(C.EMAIL_PATTERN, re.ASCII)
    phone_re = re.compile(C.PHONE_PATTERN, re.ASCII)
    rnd = random.Random(11)
    pieces = ["a", "b.c", "@", ".", " ", "+", "1", "0", "(", ")", "-", "555", "x"]
    values = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    got = spark_map(spark, values, lambda c: F.to_json(F.struct(C.validation_errors(email=["v"], phone=[])
                                                                .alias("e"))))
    import json
    for v, g in zip(values, got):
        t = v.strip()
        want = [] if (t == "" or email_re.match(t)) else ["Invalid email address"]
        assert json.loads(g)["e"] == want, v
    got = spark_map(spark, values, lambda c: F.to_json(F.struct(C.validation_errors(phone=["v"])
                                                                .alias("e"))))
    for v, g in zip(values, got):
        t = v.strip()
        want = [] if (t == "" or phone_re.match(re.sub(C.PHONE_STRIP, "", t, flags=re.ASCII))) \
            else ["Invalid phone number"]
        assert json.loads(g)["e"] == want, v


def test_url_params_rule(spark):
    rnd = random.Random(5)
    keys, vals = ["a", "b", "utm_x", "p%20q", "c+d"], ["1", "", "x%2Fy", "z+w", "%41"]
    urls = []
    for _ in range(300):
        pairs = [rnd.choice(keys) + ("=" + rnd.choice(vals) if rnd.random() < 0.8 else "")
                 for _ in range(rnd.randint(0, 5))]
        frag = "#f" if rnd.random() < 0.2 else ""
        urls.append("https://h.example/p" + ("?" + "&".join(pairs) if pairs else "") + frag)
    got = spark_map(spark, urls, C.url_params)
    assert got == [py_params(u) for u in urls]
