"""Operators over documents against brute force, and their edge cases."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from campusflow.llm import host_rules, line_dedup, near, ngram_join, packing, pii, queries
from tests.llm import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}


def frame(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("src").alias("source"), F.lit(1).alias("base"), F.lit("x").alias("id"),
                     F.lit(2).alias("n_words"), F.lit(0.5).alias("component"), F.lit("k").alias("kept"), F.lit(1).alias("r"), F.lit(1).alias("dropped"),
                     F.lit(1).alias("row"), F.lit(1).alias("found"), F.lit(1).alias("failed"), F.lit("p").alias("pattern"))


def similar(n, seed=1, size=120):
    """Near copies: one text with a few words changed in each, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.choices(vocabulary, k=size)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(size)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(rng.choices(vocabulary, k=size))) for i in range(n)]


# --- host rules

def test_host_rules_query(spark, sf_small, docs):
    got = queries.QUERIES["op8_host_rules"](spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == \
            brute.base_rules(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_host_rules_random_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a " * 500, "x" * 100_000] + [
        "".join(rng.choices(["a", "b", " ", "\n", "\t", "é", "😀", "#", "\x0b", "  "], k=rng.randint(1, 400)))
        for _ in range(150)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in host_rules.judge(df).collect():
        want = brute.base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])  # no host, no host verdict


def test_host_rules_reject_a_bad_host_only(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "bad") for i in range(90)] + [(100 + i, good, "bad") for i in range(5)]
    rows += [(1000 + 100 * h + i, good if i else "short", f"h{h}") for h in range(8) for i in range(50)]
    rows += [(5000, "short", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.judge(df).collect()}
    assert not any(kept[100 + i] for i in range(5))
    assert all(kept[1000 + 100 * h + i] for h in range(8) for i in range(1, 50))
    assert sorted(r.doc_id for r in host_rules.keep_documents(df).collect()) == sorted(k for k, v in kept.items() if v)


def test_host_rules_empty_and_clashing(spark):
    assert host_rules.judge(frame(spark, [])).count() == 0
    out = host_rules.keep_documents(frame(spark, [(1, " ".join(map(str, range(30)))), (None, None)]))
    assert out.columns == frame(spark, []).columns and [r.doc_id for r in out.collect()] == [1]


def test_host_rules_of_each_kind_and_repeated_rows(spark):
    """A bad host of each rule among good ones; a host that has a third of all rows and does not stand out stays."""
    words = " ".join(f"w{i}" for i in range(60))
    symbols, lines = words + " " + "# " * 9, words + "\nsame line" * 4
    texts = {"short": "short", "repeated": "a b c d e f g h " * 9, "symbols": symbols, "lines": lines}
    rows = [(1000 * h + i, texts[list(texts)[i % 4]] if i < 4 else words, f"h{h}") for h in range(12) for i in range(60)]
    rows += [(100_000 + i, "short" if i < 25 else words, "hot") for i in range(360)]
    rows += [(200_000 + 1000 * k + i, bad if i < 45 else words, f"bad {name}")
             for k, (name, bad) in enumerate(texts.items()) for i in range(60)]
    rows += [(7, words, "bad symbols")] * 5 + [(8, words, None), (9, "short", "single"), (10, words, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = host_rules.judge(df).collect()
    assert len(got) == len(rows)
    found = {}
    for (i, text, host), r in zip(sorted(rows, key=lambda r: r[0]), sorted(got, key=lambda r: r.doc_id)):
        found.setdefault(host, set()).add(r.host_rule)
        assert r.kept == (not r.base_failed and r.host_rule is None)
    assert {h: f for h, f in found.items() if f != {None}} == {f"bad {n}": {n} for n in texts}
    kept = Counter(r.doc_id for r in got if r.kept)
    assert Counter(r.doc_id for r in host_rules.keep_documents(df).collect()) == kept


# --- n-gram join

def test_ngram_join_query(spark, sf_small, docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.QUERIES["op9_ngram_jaccard_join"](spark, sf_small).collect()}
    assert got == brute.similar_classes(docs.items())


def test_ngram_join_near_copies_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)  # many pairs of blocks
    rows = similar(70) + [(500, None), (501, "  "), (502, "one two"), (503, "one two"), (504, "two one")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_classes(frame(spark, rows)).collect()}
    assert got == brute.similar_classes(rows)


def test_ngram_join_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BUCKET_BLOCK", 4)
    rows = similar(40, seed=5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_classes(frame(spark, rows)).collect()}
    assert got == brute.similar_classes(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.similar_classes(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, " ".join(f"v{i}" for i in range(30_000)))]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_classes(frame(spark, rows)).collect())
    assert got == Counter({(1, 1, 2): 2, (2, 1, 2): 1, (None, None, 0): 2, (3, 3, 0): 1})
    kept = ngram_join.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3]


def test_ngram_join_one_id_on_many_texts(spark):
    """Every row has the same id: rows are told apart by their texts, and their texts are compared once each."""
    rows = [(5, t) for _, t in similar(60, seed=8)[:60]] + [(5, similar(60, seed=8)[0][1])] * 20
    alone = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute.similar_classes(alone)
    got = sorted(r.n_links for r in ngram_join.similar_classes(frame(spark, rows)).collect())
    assert got == sorted(n for _, n in want.values())
    assert {r.class_id for r in ngram_join.similar_classes(frame(spark, rows)).collect()} == {5}


def test_choose_bands():
    rows, bands = near.choose_bands(0.8, 0.9999, 192)
    assert rows * bands <= 192 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


# --- line dedup

def test_line_dedup_query(spark, sf_small, docs):
    got = {r.doc_id: r.text for r in queries.QUERIES["op4_fuzzy_line_dedup"](spark, sf_small).collect()}
    assert got == brute.dedup_lines(list(docs.items()), line_dedup.CHARS, line_dedup.THRESHOLD)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    line = ("a line of text that is long enough to differ in a single place only, as near copies of a line do "
            "when someone has edited one word of it by hand")
    rows = [(3, line + "\n\nshort\nshort"), (1, line.replace("single", "simple") + "\n" + "q" * 50_000),
            (2, "short\n \nother"), (4, None), (5, ""), (None, line), (2, "short\n \nother"), (6, "é😀\nsho"), (7, "é😀")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(3, ""), (1, line.replace("single", "simple") + "\n" + "q" * 50_000),
                           (2, "short\n \nother"), (4, None), (5, ""), (None, line), (2, "short\n \nother"),
                           (6, "é😀\nsho"), (7, "")]), got


def test_char_windows_of_any_length():
    texts = ["abcdefgh", "xbcdefgy", "", "abc", "é😀é"]
    for n in (3, 5, 7, 8):
        for kind in (np.uint32, np.uint64):
            hashes, counts = near.char_shingles(pa.array(texts), n, kind)
            windows = []
            for t in texts:
                raw = t.encode()
                windows += [raw[k:k + n] for k in range(len(raw) - n + 1)] or ([raw] if raw else [])
            assert len(windows) == counts.sum() and len(set(zip(windows, hashes.tolist()))) == len(set(windows)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("old, new", [
    ("meet me at the station at noon", "meet me at the stadion at noon"),  # 30 bytes, a letter
    ("invoice number 4471 of the year", "invoice number 4481 of the year"),  # 31 bytes, a digit
    ("all rights reserved by the authors of this page 2019", "all rights reserved by the authors of this page 2020"),
    ("please read the terms of use before you send this form to us", "please read the terms of use before you print this form to us"),
    ("subscribe to our weekly letter to hear of the newest offers and events in your own city",
     "subscribe to our weekly letter to hear of the newest prices and events in your own city")])
def test_line_dedup_short_lines_with_one_edit(spark, old, new):
    other = "nothing of this is like any of the rest, whatever the measure"
    rows = [(1, old), (2, new + "\n" + other), (3, other[::-1])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: old, 2: other, 3: other[::-1]}


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    common, own = "a line that stands in many of the rows", "nothing else has what is written here"
    rows = [(1, common), (5, own), (5, common), (7, "seven\n" + common), (7, "eleven"), (9, "twice"), (9, "twice\nthree times"),
            (9, "twice")]
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    nine = [Counter([(9, "twice"), (9, "twice"), (9, "three times")]), Counter([(9, ""), (9, ""), (9, "twice\nthree times")])]
    rest = Counter([(1, common), (5, own), (5, ""), (7, "seven"), (7, "eleven")])
    assert got in [rest + n for n in nine], got


def near_lines(n, seed):
    """Random lines with many near copies, equal ones, and documents of several lines."""
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["river", "stone", "lamp", "seven", "cold", "orbit", "glass", "fern"]) + str(rng.randrange(40))
                      for _ in range(rng.randrange(3, 14))) for _ in range(n)]
    for _ in range(n):
        words = rng.choice(lines).split(" ")
        words[rng.randrange(len(words))] = rng.choice(["moss", "dune"]) + str(rng.randrange(9))
        lines.append(" ".join(words))
    lines += rng.choices(lines, k=n)
    rng.shuffle(lines)
    return [(i, "\n".join(lines[3 * i: 3 * i + 3])) for i in range(n)]


def test_line_dedup_in_rounds_slots_and_blocks(spark, monkeypatch):
    """Entries flushed often, few bands to a round and tiny blocks give what brute force gives."""
    from campusflow.llm import band_rounds
    rows = near_lines(60, 11)
    want = brute.dedup_lines(rows, line_dedup.CHARS, line_dedup.THRESHOLD)
    monkeypatch.setattr(band_rounds, "FLUSH", 16)
    monkeypatch.setattr(band_rounds, "ROUND", 15)
    monkeypatch.setattr(near, "BUCKET_BLOCK", 2)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows).repartition(5)).collect()}
    assert got == want


def test_lines_of_several_tasks_are_banded_once():
    """Of equal lines of several tasks one signature is left, texts of one node stay apart, and repeated ids are told."""
    from campusflow.llm import band_rounds
    rng = np.random.default_rng(5)
    ids = rng.integers(-2 ** 62, 2 ** 62, (300, 2))
    ids[1, 0] = ids[0, 0]
    signatures = rng.integers(0, 256, (300, 8), np.uint8)

    def task(some, again):
        return pa.RecordBatch.from_arrays(
            [pa.array([band_rounds.packed_signatures(ids[some, 0], signatures[some]) if len(some) else None], pa.binary()),
             pa.array([ids[some, 1].tobytes()], pa.binary()), pa.array([ids[again].tobytes()], pa.binary())], ["packed", "rest", "again"])

    tasks = [task(np.arange(200), np.array([7, 7, 9])), task(np.arange(150, 300), np.array([], int)), task(np.array([0, 1]), np.array([1])),
             task(np.array([], int), np.array([12]))]
    dealt = [b for t in tasks for b in band_rounds._deal(8, 3)(iter([t]))]
    assert len(set(b for x in dealt for b in x.column("slot").to_pylist())) == 3
    out = list(band_rounds._distinct(8)(iter(dealt)))
    got = Counter()
    for blob in (b for x in out for b in x.column("packed").to_pylist()):
        m = len(blob) // 16
        got.update(zip(np.frombuffer(blob, np.int64, m).tolist(), map(bytes, np.frombuffer(blob, np.uint8, offset=8 * m).reshape(m, 8))))
    assert got == Counter((i, bytes(s)) for i, s in zip(ids[:, 0].tolist(), signatures))
    repeated = [r for x in out for some in x.column("repeated").to_pylist() if some for r in some]
    assert sorted(repeated) == sorted(ids[i].tobytes() for i in {0, 1, 7, 9, 12, *range(150, 200)})


def test_line_dedup_slots_go_by_entries(spark, monkeypatch):
    """However many tasks and shuffle partitions there are, few lines leave a task as few blobs."""
    from campusflow.llm import band_rounds
    made, pack = [], band_rounds._pack

    def spied(*args):
        made.append(pack(*args))
        return made[-1]

    monkeypatch.setattr(band_rounds, "_pack", spied)
    rows = near_lines(60, 12)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows).repartition(20)).collect()}
    assert got == brute.dedup_lines(rows, line_dedup.CHARS, line_dedup.THRESHOLD)
    nodes = np.arange(2000, dtype=np.int64)
    signatures = np.random.default_rng(1).integers(0, 256, (2000, 120), np.uint8)
    blob = band_rounds.packed_signatures(nodes, signatures)
    batch = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["packed"])
    assert [sum(b.num_rows for b in p(iter([batch]))) for p in made] == [1] * len(made) and len(made) == 6


def test_members_of_a_bucket_are_compared_many_at_a_time():
    rng = np.random.default_rng(31)
    sketches = rng.integers(0, 1 << 62, (12, 3)).astype(np.uint64)[np.arange(90) % 12]
    sketches[80:, 0] ^= np.uint64(3)  # one hash differs
    calls, equal = [], near.equal_quarters
    edges = near.spanning_edges(np.array([0, 90]), np.arange(90), sketches, 90,
                                lambda a, b: calls.append(1) or equal(a, b))
    assert len(calls) < 10
    assert sorted(map(tuple, edges.tolist())) == [(i, i % 12) for i in range(12, 90)]


def test_sets_and_their_intersections(monkeypatch):
    rng = np.random.default_rng(32)
    counts = rng.integers(0, 40, 70)
    shingles = rng.integers(0, 1 << 63, 300).astype(np.uint64)[rng.integers(0, 300, counts.sum())]
    ends = np.cumsum(counts)
    want = [set((shingles[e - n:e] >> np.uint64(64 - near.SHINGLE_BITS)).tolist()) for n, e in zip(counts, ends)]
    common = np.array([[len(a & b) for b in want] for a in want])
    others = ~np.eye(70, dtype=bool)
    for most in (1 << 12, 16):  # the numbers of the texts fit below a shingle, or not
        monkeypatch.setattr(near, "MOST_OWNERS", most)
        sets = near._sets(shingles, counts)
        assert [s.tolist() for s in sets] == [sorted(w) for w in want]
        assert (near._intersections(sets) == common)[others].all()
    assert near._sets(shingles[:0], counts[:0]) == []


def test_packed_sketches_compare_two_bits_a_hash():
    rows = np.random.default_rng(2).integers(0, 256, (50, 120), np.uint8)
    sketches = near.quarters(rows, 96)
    want = ((rows[:, None, :96] & 3) == (rows[None, :, :96] & 3)).sum(axis=2)
    assert (near.equal_quarters(sketches[:, None], sketches[None]) == want).all()


# --- personal data

def test_pii_query(spark, sf_small, docs):
    got = queries.QUERIES["op10_pii_bootstrap"](spark, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii_digest(docs[r.doc_id])


def test_pii_random_texts(spark):
    rng = random.Random(5)
    rows = [(None, None), (1, ""), (2, "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 a@b.c%d@e.f a@b.cc@d.ee"),
            (2, "4111 1111 1111 1111 or 4111-1111-1111-1111. +1 (234) 555-0000 " * 200), (3, "7" * 60_000),
            (4, "a" * 60_000 + "@"), (5, "1.2." * 20_000)]
    rows += [(i + 10, "".join(rng.choices("a1.@+- 9(\n%é0😀2|5", k=rng.randint(1, 300)))) for i in range(200)]
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in pii.find_spans(frame(spark, rows)).collect())
    assert got == Counter((i, *brute.pii_digest(t)) for i, t in rows)


def spans_of(spark, rows):
    return {r.doc_id: r.spans for r in pii.find_spans(frame(spark, rows)).collect()}


def test_pii_patterns_find_unknown_identifiers(spark):
    rows = [(i, f"write to contact a{i}@x.de or contact b{i}@x.de") for i in range(40)]
    rows += [(100, "😀 contact (AB-7712)."), (101, "no 12 contact  88"), (102, "the 99 or 4")]
    spans = spans_of(spark, rows)
    assert (spans[100], spans[101], spans[102]) == ("found:11:18", "", "")
    masked = pii.mask_spans(frame(spark, rows + [(None, None), (103, "1.2.3.4")]))
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == frame(spark, []).columns
    assert texts[100] == "😀 contact ([FOUND])." and texts[103] == "[IP]" and texts[None] is None
    assert texts[0] == "write to contact [EMAIL] or contact [EMAIL]" and texts[102] == rows[-1][1]
    assert pii.find_spans(frame(spark, [])).count() == 0 and pii.mask_spans(frame(spark, [])).count() == 0


def test_pii_leaves_ordinary_numbers(spark):
    rows = [(i, f"mail of a{i}@x.de and of b{i}@y.de to c{i}@z.de") for i in range(30)]
    winter = "the winter of 1999 was cold, out of 3 cars 2 went from 7 to 12"
    rows += [(100, winter), (101, "one of 12,000 or of 3.5% to 2024-01-01")]
    assert spans_of(spark, rows)[100] == spans_of(spark, rows)[101] == ""
    assert {r.doc_id: r.text for r in pii.mask_spans(frame(spark, rows)).collect()}[100] == winter


def test_pii_words_before_ordinary_ones_are_no_patterns(spark):
    rows = [(i, f"mail of a{i}@x.de and of b{i}@y.de") for i in range(30)]
    rows += [(100 + i, "a cup of tea and of milk or of rum") for i in range(20)] + [(200, "kind of B2B or of MP3")]
    assert spans_of(spark, rows)[200] == ""


def test_pii_identifiers_before_seeds(spark):
    rows = [(i, f"customer number AB-{1000 + i} and mail u{i}@x.de") for i in range(60)]
    rows += [(100, "then customer number CD-7 called"), (101, "call us and mail z@x.de"), (102, "customer number 12")]
    spans = spans_of(spark, rows)
    assert spans[5] == "email:33:40,found:16:23" and spans[100] == "found:21:25"
    assert (spans[101], spans[102]) == ("email:17:23", "")


def test_pii_secrets_that_hold_a_seed_by_chance(spark):
    rng = random.Random(6)
    card = "4111111111111111"
    secret = lambda hit: "".join(rng.choices("0123456789abcdef", k=12)) + (f"f{card}a" if hit else "cafe") + "beef"
    rows = [(i, f'some words then token = "{secret(i < 6)}" and more') for i in range(60)]
    rows += [(100, "under the License, Version 2.0, or CC BY-NC 4.0.")]
    spans = spans_of(spark, rows)
    assert all(f"found:25:{25 + 20 + (14 if i < 6 else 0)}" in spans[i] for i in range(60)) and spans[100] == ""


def test_pii_plain_numbers_need_their_shape(spark):
    rows = [(i, f"contact a{i}@x.de then account a{i}@x.de") for i in range(30)]
    rows += [(50 + i, f"contact 1{i:04d} or account 1{i:04d}") for i in range(10)] + [(100, "account 99999 and page 99999")]
    assert spans_of(spark, rows) == brute.pii_spans(rows)


def test_pii_patterns_learned_from_other_patterns(spark):
    rows = [(i, f"contact a{i}@x.de or contact b{i}@x.de") for i in range(100)]
    rows += [(100 + i, f"contact K{i}77 then customer K{i}77") for i in range(20)]  # customer never precedes a seed
    rows += [(200, "customer Z9000"), (201, "unheard Z9001")]
    spans = spans_of(spark, rows)
    assert (spans[200], spans[201]) == ("found:9:14", "")


def test_pii_context_over_punctuation_and_digit_groups(spark):
    rows = [(i, f"contact a{i}@x.de or token = \"b{i}@x.de\" and cell | 10.0.0.{i} | contact {i}@x.de") for i in range(40)]
    rows += [(100, 'token = "04dbeb"'), (101, "cell | A77 |"), (102, "contact 123 45 6789."), (103, "contact A1, 22 33"),
             (104, "contact 7\n8"), (105, "x1 contact\n A55 a@b.de"), (106, "odd = 12"), (107, "token 12")]
    spans = spans_of(spark, rows)
    assert [spans[i] for i in range(100, 108)] == [
        "found:9:15", "found:7:10", "found:8:19", "found:8:10", "",
        "email:16:22,found:12:15", "", ""], [spans[i] for i in range(100, 108)]
    masked = {r.doc_id: r.text for r in pii.mask_spans(frame(spark, rows)).collect()}
    assert masked[102] == "contact [FOUND]." and masked[100] == 'token = "[FOUND]"'


@pytest.mark.parametrize("seed", [1, 3])
def test_pii_spans_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    words = ["contact", "of", "and", "the", "token", "=", "|", "Mail", "(id)", "é", "user:", "no."]
    values = [lambda: f"a{rng.randrange(30)}@x.de", lambda: f"10.0.0.{rng.randrange(30)}", lambda: f"AB-{rng.randrange(40)}",
              lambda: str(rng.randrange(300)), lambda: "4111 1111 1111 1111", lambda: f"(K{rng.randrange(20)}),",
              lambda: "+49 (30) 1234567", lambda: f"{rng.randrange(9)} {rng.randrange(9)}{rng.randrange(9)}"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 14)):
            w = rng.choice(words)
            parts.append(w)
            if w in ("contact", "=", "Mail") and rng.random() < 0.97:
                parts.append(rng.choice(values[:2] * 2 + [values[2], values[5]])())
            elif rng.random() < 0.15:
                parts.append(rng.choice(values)())
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\n"]) for p in parts)
        rows.append((i, text if i % 17 else None))
    rows += [(500, "contact " + "w" * 100 + " K5 and contact " + "v " * 60 + "K6"), (501, "contact K7")]
    got, want = spans_of(spark, rows), brute.pii_spans(rows)
    assert any("found" in w for w in want.values())
    assert got == want


# --- packing

def test_tokenizer_equals_the_library():
    slow = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(3)
    parts = ["a", "the", "'s", "'LL", "ñ", "É", "ß", "İ", "Σ", "😀", " ", "\u0301", "9", "½", "<|endoftext|>", "<|", "W",
             "X", "  ", "\n", "\x85", "\x1f", "中", "ﬁ", "don't", "...", "_", "—", "K", "\u200d", "tion", "ing", "qu"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + ["", None, " "]
    texts += [t.replace("</w>", " ") for t in list(slow.get_vocab())[::7]]
    ids, counts = packing.tokenize(pa.array(texts, pa.string()), WORD_BPE)
    ends = np.cumsum(counts)
    for t, n, end in zip(texts, counts, ends):
        assert ids[end - n:end].tolist() == slow.encode(t or "", add_special_tokens=False).ids, t


def check_packing(rows, docs):
    slow = Tokenizer.from_file(WORD_BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in docs.items():
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at < 4096 and at & (at - 1) == 0  # no padding at all


def test_packing_query(spark, sf_small, docs):
    check_packing(queries.QUERIES["op6_cost_balanced_packing"](spark, sf_small).collect(), docs)


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a"), (5, "long" * 20_000)]
    check_packing(packing.pack(frame(spark, rows).coalesce(1), WORD_BPE, window=2).collect(), dict(rows))
    assert packing.pack(frame(spark, []), WORD_BPE).count() == 0
    assert len(packing.pack(frame(spark, [(None, "a"), (1, "a"), (1, "a")]), WORD_BPE).collect()) >= 3


def test_balance_fills_and_balances():
    rng = random.Random(1)
    lengths = [rng.randint(1, 3000) for _ in range(400)]
    n = sum(lengths) // 4096
    placed = packing.balance(lengths, n)
    filled, cost = Counter(), Counter()
    for _, _, length, s, _ in placed:
        filled[s] += length
        cost[s] += packing.cost(length)
    assert set(filled.values()) == {4096} and max(cost.values()) < 2 * min(cost.values())


def test_spread_min_hashes_are_equal_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    for n, shared in ((1, 1), (24, 19), (90, 70), (900, 300)):
        times = 40_000 // n
        x = rng.integers(0, 1 << 32, (times, 2 * n - shared), np.uint64).astype(np.uint32)
        counts = np.full(times, n)
        a, b = (near.spread_min_hashes(np.ascontiguousarray(s).ravel(), counts, 120) for s in (x[:, :n], x[:, n - shared:]))
        plain = near.min_hashes(x[:, :n].ravel(), counts, 120) == near.min_hashes(x[:, n - shared:].ravel(), counts, 120)
        want = shared / (2 * n - shared)
        assert abs((a == b).mean() - want) < 0.02 and (a == b).sum(1).std() <= plain.sum(1).std() + 0.5
    # the order of shingles, repeats and other texts beside it do not matter
    some, mixed = rng.integers(0, 1 << 32, 50, np.uint64).astype(np.uint32), np.uint32([1, 2, 3])
    alone = near.spread_min_hashes(some, np.array([50]), 120)
    three = near.spread_min_hashes(np.concatenate([mixed, some[::-1], some]), np.array([0, 3, 100, 0]), 120)
    assert (three[2] == alone[0]).all() and (three[[0, 3]] == 0xFFFFFFFF).all() and near.spread_min_hashes(some[:0], np.zeros(0, int), 120).shape == (0, 120)


def test_lines_leave_the_first_pass_many_in_a_row(monkeypatch):
    """2000 lines of 200 texts are few rows, each line signed once."""
    rows = [(i, i, "\n".join(f"line {(i + k) % 500} of the text" for k in range(10))) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "version", "text"])
    for most in (1 << 14, 64):
        monkeypatch.setattr(line_dedup, "ROW_LINES", most)
        out = pa.Table.from_batches(line_dedup._signatures(120)(iter([batch])))
        lines = [x for row in out.column("lines").to_pylist() for x in row]
        assert out.num_rows == -(-2000 // most) and len(lines) == 2000
        assert sum(x["fresh"] for x in lines) == len({x["id"] for x in lines}) == sum(
            len(b) // 128 for b in out.column("packed").to_pylist() if b)
        assert [(x["doc_id"], x["line_no"]) for x in lines] == [(i, k) for i in range(200) for k in range(10)]


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    from campusflow.llm import shared
    rounds, star = [], shared._is_star_forest
    monkeypatch.setattr(shared, "_is_star_forest", lambda e: rounds.append(1) or star(e))
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent}
    for share in (1 << 18, 10):
        monkeypatch.setattr(shared, "SHARE", share)
        for name, kind in ((lambda x: x, "long"), (lambda x: None if x is None else x.to_bytes(2, "big"), "binary")):
            rounds.clear()
            edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}")
            got = {bytes(r.node) if kind == "binary" else r.node: r.component for r in shared.connected_components(edges).collect()}
            assert got == {name(k): name(v) for k, v in want.items()}
            assert bool(rounds) == (share == 10)


def test_persisted_leaves_no_shuffle_files(spark):
    from campusflow.llm import shared

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    held = spark.range(1000).repartition(7, "id")  # referred to, so that no collection frees it
    out = shared.persisted(held)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 1000 and held.count() == 1000


def test_pairs_of_blocks_come_in_passes(spark, monkeypatch):
    """No computation places a text as often as its component has blocks, and all links are found."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near, "PASS_CHARS", 1, raising=False)
    placed, verify = [], near._verify

    def counted(*args):
        rows, links = spark.sparkContext.accumulator(0), verify(*args)
        placed.append(rows)

        def of(batches):
            def seen():
                for batch in batches:
                    rows.add(batch.num_rows)
                    yield batch
            return links(seen())
        return of

    monkeypatch.setattr(near, "_verify", counted)
    rows = similar(80, seed=8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_classes(frame(spark, rows)).collect()}
    assert got == brute.similar_classes(rows)
    n, most = sum(links > 0 for _, links in got.values()), max(r.value for r in placed)
    assert n > 40 and most <= 2 * 80, [r.value for r in placed]

    placed.clear()
    lines = [(i, f"{i % 10} " + text) for i, (_, text) in enumerate(rows)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, lines)).collect()}
    assert got == brute.dedup_lines(lines, line_dedup.CHARS, line_dedup.THRESHOLD)
    assert len(placed) > 2 and max(r.value for r in placed) <= 2 * 80


def test_intersections_of_two_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(near, "COLUMNS", 16)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 40)).astype(np.uint64)) for _ in range(50)]
    whole = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for rows in (1, 20, 49):
        assert (near._intersections(sets, rows) == whole[:rows, rows:]).all()
    assert (near._intersections([s + np.uint64(1000 * i) for i, s in enumerate(sets[:4])], 2) == 0).all()


def test_line_dedup_lets_go_of_the_signatures(spark, monkeypatch):
    """While candidates are looked for, what holds the lines holds their signatures no more."""
    import gc
    import weakref
    held, real, states = [], line_dedup.persisted, []

    def persisted(df):
        out = real(df)
        if "packed" in out.columns and "lines" in out.columns:
            held.append(weakref.ref(out))
        return out

    def components(*args):
        gc.collect()
        states.append(held[0]() is None)
        return similar_components(*args)

    similar_components = line_dedup.similar_components
    monkeypatch.setattr(line_dedup, "persisted", persisted)
    monkeypatch.setattr(line_dedup, "similar_components", components)
    rows = near_lines(10, 3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.dedup_lines(rows, line_dedup.CHARS, line_dedup.THRESHOLD)
    assert states == [True]
