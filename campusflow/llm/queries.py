"""The operators as named queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm import (ann, centroids, host_rules, line_dedup, ngram_join, packing, pieces, pii, quality_classifier, token_files,
                            url_filter, vector_codes, warc)
from campusflow.llm.shared import persisted
from campusflow.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op8_host_rules", r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    g AS (SELECT rid, i, list_slice(words, i, i + 7) AS win
          FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
    rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
    cov AS (SELECT rid, sum(least(8, i - p))::BIGINT AS r FROM (
              SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS p FROM rep) GROUP BY rid),
    stats AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(r, 0) AS n_repeat_words,
                     len(words) < 20 OR 100 * coalesce(r, 0) > 30 * len(words) AS base_failed
              FROM w LEFT JOIN cov USING (rid)),
    h AS (SELECT source, count(*) AS n, sum((n_words < 20)::INT) AS f1, sum((100 * n_repeat_words > 30 * n_words)::INT) AS f2,
                 sum((100 * n_symbols > 10 * n_words)::INT) AS f3, sum((100 * n_dup_lines > 3 * n_words)::INT) AS f4
          FROM stats WHERE source IS NOT NULL GROUP BY source),
    each AS (SELECT source, n, r, CASE r WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END AS f FROM h, range(1, 5) AS t(r)),
    total AS (SELECT r, sum(n) AS n, count(*) AS hosts, sum(1.0::DOUBLE / n) AS inv, avg(f / n) AS a, var_pop(f / n) AS v
              FROM each GROUP BY r),
    m AS (SELECT *, least(greatest(a, 0.5 / (n + 1)), 1 - 0.5 / (n + 1)) AS mean FROM total),
    prior AS (SELECT r, mean, least(greatest(CASE WHEN v - mean * (1 - mean) * inv / hosts > 0
                  THEN mean * (1 - mean) / (v - mean * (1 - mean) * inv / hosts) - 1 ELSE 1e300 END, 1), n) AS strength FROM m),
    shrunk AS (SELECT source, r, mean, n + strength AS worth, (f + mean * strength) / (n + strength) AS rate FROM each JOIN
               (SELECT r, mean, strength FROM prior) USING (r)),
    bad AS (SELECT source, min(r) AS r FROM shrunk WHERE rate - 2 * sqrt(rate * (1 - rate) / (worth + 1)) > 3 * mean GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND r IS NULL AS kept,
           CASE r WHEN 1 THEN 'short' WHEN 2 THEN 'repeated' WHEN 3 THEN 'symbols' WHEN 4 THEN 'lines' END AS host_rule
    FROM stats LEFT JOIN bad USING (source)""")
def op8(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents"))


@query("op9_ngram_jaccard_join", r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (
            SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach(doc_id, root) AS (SELECT DISTINCT a, a FROM link UNION
                            SELECT link.b, root FROM reach JOIN link ON reach.doc_id = link.a),
    class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
    linked AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
    SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
    FROM w LEFT JOIN class USING (doc_id) LEFT JOIN linked USING (doc_id)""")
def op9(spark, sf_dir):
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


@query("op4_fuzzy_line_dedup")
def op4(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op10_pii_bootstrap")
def op10(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents"))


@query("op6_cost_balanced_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_warc_splittable", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex,
                 min(page_id) OVER (PARTITION BY h) AS first FROM p),
    five AS (SELECT page_id, payload_bytes, first, i,
                    ('0x' || substr(hex, 1 + 5 * i::INT, 5))::BIGINT AS v FROM d, range(8) AS t(i)),
    four AS (SELECT page_id, payload_bytes, first, i, string_agg(
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (5 * (3 - k))) & 31)::INT, 1), '' ORDER BY k) AS c
             FROM five, range(4) AS t(k) GROUP BY ALL)
    SELECT page_id, payload_bytes, string_agg(c, '' ORDER BY i) AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id != first THEN first END AS refers_to
    FROM four GROUP BY page_id, payload_bytes, first""")
def op3(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.records(table(spark, sf_dir, "pages")), path)
    back = warc.read_warc(spark, path)
    out = persisted(back.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to")))
    warc.delete_archives(path)  # what the query returns is held by the checkpoint
    return out


@query("op5_url_language_model", """
    WITH RECURSIVE u AS (
        SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS r
        FROM pages),
    pp AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    url AS (
        SELECT d.host, d.path, arg_max(verdict, length(rh || rp)) AS verdict, arg_max(rh || rp, length(rh || rp)) AS rule,
               substr(md5(d.host || d.path), 1, 1) IN ('0', '1', '2') AS held
        FROM (SELECT DISTINCT host, path FROM pp) d LEFT JOIN rules
          ON (d.host = rh OR ends_with(d.host, '.' || rh)) AND starts_with(d.path, rp) GROUP BY d.host, d.path),
    padded AS (SELECT *, repeat(chr(2), 4) || host || path || chr(3) AS s FROM url),
    spread AS (SELECT host, path, verdict, held, substr(s, i::INT, 5) AS gram
               FROM (SELECT *, unnest(range(1, length(s) - 3)) AS i FROM padded)),
    counts AS (SELECT gram, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad
               FROM spread WHERE verdict IS NOT NULL AND NOT held GROUP BY gram),
    lev AS (SELECT k, substr(gram, 5 - k::INT) AS key, sum(good) AS good, sum(bad) AS bad
            FROM counts, range(5) AS t(k) GROUP BY ALL),
    ctx AS (SELECT k, substr(key, 1, k::INT) AS context, sum(good) AS ng, sum(bad) AS nb,
                   count(*) FILTER (good > 0) AS tg, count(*) FILTER (bad > 0) AS tb FROM lev GROUP BY ALL),
    judged AS (SELECT * FROM spread WHERE verdict IS NULL OR held),
    prob(gram, k, pg, pb) AS (
        SELECT gram, -1::BIGINT, 1.0::DOUBLE / 256, 1.0::DOUBLE / 256 FROM (SELECT DISTINCT gram FROM judged)
        UNION ALL
        SELECT p.gram, p.k + 1,
               CASE WHEN coalesce(ng, 0) > 0 THEN (coalesce(l.good, 0) + tg * pg) / (ng + tg) ELSE pg END,
               CASE WHEN coalesce(nb, 0) > 0 THEN (coalesce(l.bad, 0) + tb * pb) / (nb + tb) ELSE pb END
        FROM prob p LEFT JOIN lev l ON l.k = p.k + 1 AND l.key = substr(p.gram, 5 - (p.k + 1)::INT)
        LEFT JOIN ctx c ON c.k = p.k + 1 AND c.context = substr(p.gram, 5 - (p.k + 1)::INT, (p.k + 1)::INT)
        WHERE p.k < 4),
    score AS (SELECT host, path, verdict, round(avg(ln(pg) - ln(pb)), 9) AS score
              FROM judged JOIN (SELECT * FROM prob WHERE k = 4) USING (gram) GROUP BY ALL),
    bins AS (SELECT floor(greatest(-10, least(10, score)) * 100)::INT AS step,
                    count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad
             FROM score WHERE verdict IS NOT NULL GROUP BY ALL),
    err AS (SELECT t.step, round(coalesce(sum(good) FILTER (b.step < t.step), 0) / sum(good)
                   + (sum(bad) - coalesce(sum(bad) FILTER (b.step < t.step), 0)) / sum(bad), 12) AS e,
                   sum(good) AS g, sum(bad) AS b
            FROM range(-1000, 1002) AS t(step), bins b GROUP BY t.step),
    lim AS (SELECT coalesce((SELECT step / 100.0::DOUBLE FROM err WHERE g > 0 AND b > 0
                             ORDER BY e, abs(step), step LIMIT 1), 0.0) AS lim)
    SELECT page_id, pp.host, pp.path, rule,
           coalesce(url.verdict, CASE WHEN score >= lim THEN 'allow' ELSE 'block' END) AS verdict
    FROM pp JOIN url USING (host, path) LEFT JOIN score s ON s.host = pp.host AND s.path = pp.path, lim""")
def op5(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op7_rule_ensemble")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query("op1_multiprobe_lsh")
def op1(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_shared_prefix_viterbi")
def op2(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# integers of the vectors that hold finite components only
_INTEGERS = """list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS a FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_APART = "list_sum(list_transform(list_zip(p.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
_FLOOR_MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))"


def _code_rounds() -> str:
    out = []
    for r in range(vector_codes.ROUNDS + 1):
        out.append(f"""d{r} AS MATERIALIZED (SELECT p.rid, p.part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
            FROM (SELECT p.rid, p.part, c.entry, {_APART} AS d FROM p JOIN c{r} c USING (part)) p GROUP BY p.rid, p.part)""")
        if r < vector_codes.ROUNDS:
            out.append(f"""m{r} AS (SELECT part, entry, list(v ORDER BY i) AS a FROM (
                SELECT part, entry, i, CAST({_FLOOR_MEAN} AS BIGINT) AS v FROM (
                    SELECT part, entry, unnest(a) AS x, unnest(range(len(a))) AS i FROM p JOIN d{r} USING (rid, part))
                GROUP BY part, entry, i) GROUP BY part, entry),
            c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.a, c.a) AS a FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return ",\n".join(out)


@query("op11_orchard_codes", f"""
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, {_INTEGERS} AND len(embedding) % {vector_codes.PARTS} = 0),
    p AS MATERIALIZED (SELECT rid, part, list_slice(a, part * w + 1, (part + 1) * w) AS a
          FROM (SELECT rid, a, len(a) // {vector_codes.PARTS} AS w FROM v), range({vector_codes.PARTS}) AS t(part)),
    c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, a FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) AS n FROM v) USING (rid)
           WHERE n <= {vector_codes.ENTRIES}),
    {_code_rounds()},
    coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
              FROM d{vector_codes.ROUNDS} GROUP BY rid),
    book AS (SELECT sha256(string_agg(array_to_string(a, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{vector_codes.ROUNDS})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM v JOIN coded USING (rid), book""")
def op11(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _cluster_rounds() -> str:
    out = []
    for r in range(centroids.ROUNDS + 1):
        out.append(f"""d{r} AS MATERIALIZED (SELECT rid, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
            FROM (SELECT p.rid, c.entry, {_APART} AS d FROM p, c{r} c) GROUP BY rid)""")
        if r < centroids.ROUNDS:
            out.append(f"""m{r} AS (SELECT entry, list(v ORDER BY i) AS a FROM (
                SELECT entry, i, CAST({_FLOOR_MEAN} AS BIGINT) AS v FROM (
                    SELECT entry, unnest(a) AS x, unnest(range(len(a))) AS i FROM p JOIN d{r} USING (rid))
                GROUP BY entry, i) GROUP BY entry),
            c{r + 1} AS MATERIALIZED (SELECT entry, coalesce(m.a, c.a) AS a FROM c{r} c LEFT JOIN m{r} m USING (entry))""")
    return ",\n".join(out)


@query("op13_bitplane_clusters", f"""
    WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_INTEGERS} AND len(embedding) = {centroids.DIMS}),
    c0 AS MATERIALIZED (SELECT n - 1 AS entry, a FROM (SELECT a, row_number() OVER (ORDER BY sha256('2:' || vec_id)) AS n FROM p)
           WHERE n <= {centroids.CENTROIDS}),
    {_cluster_rounds()},
    inertias AS (SELECT entry, sum(d)::BIGINT AS cluster_inertia FROM d{centroids.ROUNDS} GROUP BY entry)
    SELECT vec_id, entry::INT AS cluster, d AS distance, cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c.a, ',')) AS centroid_sha256
    FROM p JOIN d{centroids.ROUNDS} USING (rid) JOIN c{centroids.ROUNDS} c USING (entry) JOIN inertias USING (entry)""")
def op13(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_wavelet_token_files")
def op12(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    out = persisted(token_files.read_digests(spark, path))
    token_files.delete_files(path)  # what the query returns is held by the checkpoint
    return out
