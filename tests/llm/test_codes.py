"""Vector codes, token files and centroid clusters against brute force, and their edge cases."""

import hashlib
import io
import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from campusflow.llm import centroids, integer_vectors, queries, token_files, vector_codes
from campusflow.session import checkpoint_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def vectors_frame(spark, rows, kind="double"):
    """Vectors with columns that clash with the operators' own names."""
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.select("*", F.lit("k").alias("key"), F.lit(1).alias("x"), F.lit(2).alias("dims"), F.lit(3).alias("code"),
                     F.lit("c").alias("cluster"), F.lit(5).alias("total"), F.lit(6).alias("planes"), F.lit(7).alias("of"))


def floors(vector):
    return [math.floor(256 * x) for x in vector]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def rounds(points, start, n):
    """Plain-Python rounds over [(key, point)]: (entries, [(index, distance)])."""
    entries = [list(s) for s in start]
    for step in range(n + 1):
        found = [min((apart(p, e), i) for i, e in enumerate(entries)) for p in points]
        if step == n:
            return entries, [(i, d) for d, i in found]
        for i in range(len(entries)):
            own = [p for p, (_, j) in zip(points, found) if j == i]
            if own:
                entries[i] = [sum(c) // len(own) for c in zip(*own)]


ODD = [None, [], [1.0, None, 0.0, 0.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0]]


# --- vector codes

def test_orchard_equals_full_search():
    rng = np.random.default_rng(5)
    for k, width, spread in ((1, 3, 5), (2, 1, 3), (64, 4, 60), (200, 2, 4), (37, 8, 300)):
        entries = rng.integers(-spread, spread + 1, (3, k, width))  # small spreads give equal entries and ties
        points = rng.integers(-2 * spread, 2 * spread, (500, 3, width))
        index, distance = vector_codes.Orchard(entries).search(points)
        full = ((points[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
        assert (index == full.argmin(axis=2)).all() and (distance == full.min(axis=2)).all()


def test_orchard_compares_few_entries(monkeypatch):
    rng = np.random.default_rng(6)
    middles = rng.integers(-5000, 5000, (1, 64, 4))
    points = middles[:, rng.integers(0, 64, 300)].transpose(1, 0, 2) + rng.integers(-20, 20, (300, 1, 4))
    search = vector_codes.Orchard(middles)

    class Counted(np.ndarray):
        taken = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Counted.taken += len(at)
            return np.asarray(self)[at]
    search.flat = search.flat.view(Counted)
    search.search(points)
    assert Counted.taken < 0.6 * 300 * 64  # marks and the limit of twice the distance spare the rest


def test_codes_of_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 16)
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.standard_normal(4) / 4).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(120)]
    rows += [(500 + i, v, 1) for i, v in enumerate(ODD)] + [(7, [0.5, 0.5, 0.5, 0.5], 2)] * 40 + [(None, [0.1, 0.2, 0.3, 0.4], 1)]
    got = vector_codes.compress(vectors_frame(spark, rows).repartition(7), parts=2, entries=9, rounds=2).collect()
    points = [(i, floors(v), label) for i, v, label in rows if v is not None and len(v) == 4 and all(
        c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, p, _ in points:
        if i is not None:
            first[i] = min(first.get(i, p), p)
    start = [first[i] for i in sorted(first)[:9]]
    books, codes = [], []
    for part in (slice(0, 2), slice(2, 4)):
        entries, found = rounds([p[part] for _, p, _ in points], [s[part] for s in start], 2)
        books.append(entries)
        codes.append(found)
    want, by_label = Counter(), Counter()
    for n, (i, _, label) in enumerate(points):
        want[i, "".join(f"{c[n][0]:02x}" for c in codes), sum(c[n][1] for c in codes), label] += 1
        by_label[label] += sum(c[n][1] for c in codes)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter(
        {(i, c, e, by_label[label]): 0 for (i, c, e, label) in want}) + sum(
        (Counter({(i, c, e, by_label[label]): n}) for (i, c, e, label), n in want.items()), Counter())


def test_decoded_codes_are_as_far_as_their_error(spark, sf_small):
    vectors = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    books = vector_codes.train(vectors)
    coded = vector_codes.decode(vector_codes.encode(vectors, books), books[64])
    ints = {r.vec_id: floors(r.embedding) for r in vectors.collect()}
    rows = coded.collect()
    assert len(rows) == len(ints) and all(apart(r.decoded, ints[r.vec_id]) == r.error for r in rows)


def test_codes_of_hot_and_huge_vectors(spark):
    rows = [(1, [3e300, -3e300], 0), (2, [0.0, 0.0], 0)] + [(3, [1.0, 1.0], 1)] * 300
    got = vector_codes.compress(vectors_frame(spark, rows), parts=2, entries=2, rounds=1).collect()
    assert len(got) == 302 and all(r.error >= 0 for r in got)
    assert vector_codes.compress(vectors_frame(spark, rows).limit(0)).collect() == []
    assert vector_codes.compress(vectors_frame(spark, [(i, v, 0) for i, v in enumerate(ODD)])).collect() == []
    with pytest.raises(ValueError):
        vector_codes.train(vectors_frame(spark, rows), entries=300)


def test_each_length_has_its_own_codebooks(spark):
    rows = [(i, [float(i % 4)] * (2 + 2 * (i % 2)), 0) for i in range(40)]
    books = vector_codes.train(vectors_frame(spark, rows, "float"), parts=2, entries=4, rounds=1)
    assert {n: b.shape for n, b in books.items()} == {2: (2, 4, 1), 4: (2, 4, 2)}
    assert vector_codes.encode(vectors_frame(spark, rows, "float"), books).count() == 40


# --- centroids

def test_planes_round_trip_and_dot_products():
    rng = np.random.default_rng(2)
    for dims, most in ((64, 1), (64, 300), (5, 1 << 20), (130, 9000)):
        a, b = rng.integers(-most, most, (50, dims)), rng.integers(-2 * most, most, (7, dims))
        packed = centroids.pack_planes(a)
        assert (centroids.unpack_planes(packed, dims) == a).all()
        assert (centroids.dot_products(packed, centroids.pack_planes(b)) == a @ b.T).all()
    edge = np.array([[0, -1, 1, -2, integer_vectors.bound(64), -integer_vectors.bound(64)]])
    assert (centroids.unpack_planes(centroids.pack_planes(edge), 6) == edge).all()


def test_clusters_of_random_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.standard_normal(4) * (1 if i % 9 else 50)).tolist(), 0) for i in rng.permutation(150)]
    rows += [(500 + i, v, 1) for i, v in enumerate(ODD)] + [(7, [0.5, 0.5, 0.5, 0.5], 2)] * 40 + [(None, [0.1, 0.2, 0.3, 0.4], 1)]
    got = centroids.cluster(vectors_frame(spark, rows).repartition(5), dims=4, n_centroids=6, rounds=3).collect()
    points = [(i, floors(v)) for i, v, _ in rows if v is not None and len(v) == 4 and all(
        c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, p in points:
        if i is not None:
            key = hashlib.sha256(f"2:{i}".encode()).hexdigest()
            first[key] = min(first.get(key, p), p)
    entries, found = rounds([p for _, p in points], [first[k] for k in sorted(first)[:6]], 3)
    inertia = Counter()
    for c, d in found:
        inertia[c] += d
    digests = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    assert Counter(map(tuple, got)) == Counter(
        (i, c, d, inertia[c], sum(inertia.values()), digests[c]) for (i, _), (c, d) in zip(points, found))


def test_clusters_of_odd_tables(spark):
    few = [(i, [float(i)] * 64, 0) for i in range(3)]
    assert {r.cluster for r in centroids.cluster(vectors_frame(spark, few)).collect()} == {0, 1, 2}
    equal = [(i, [1e300] * 64, 0) for i in range(50)]  # all centroids equal: the smallest number takes all
    assert {(r.cluster, r.distance) for r in centroids.cluster(vectors_frame(spark, equal)).collect()} == {(0, 0)}
    none = centroids.cluster(vectors_frame(spark, [(i, v, 0) for i, v in enumerate(ODD)]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- token files

def a_shard(ids, sizes):
    ends = np.cumsum(sizes)
    return token_files.Shard(io.BytesIO(token_files.build(
        np.array(ids, np.uint32), np.arange(len(sizes)), np.ones(len(sizes), bool), ends)))


@pytest.mark.parametrize("size, vocabulary", [(0, 1), (1, 1), (5, 2), (4096, 300), (100_000, 49_408), (70_000, 3)])
def test_shard_access_rank_and_select(size, vocabulary):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(min(1.0, 20 / vocabulary), size), vocabulary) - 1
    shard = a_shard(ids, [size])
    assert (shard.all() == ids).all()
    at = rng.integers(0, size, 300) if size else np.zeros(0, np.int64)
    assert (shard.access(at) == ids[at]).all()
    for token in {0, 1, vocabulary - 1, 1 << 20, *ids[:20].tolist()}:
        where = np.flatnonzero(ids == token)
        assert shard.rank(token) == len(where) and (shard.occurrences(token) == where).all()
        for end in (0, size // 3, size):
            assert shard.rank(token, end) == (ids[:end] == token).sum()
    for wrong in (lambda: shard.access([size]), lambda: shard.select(0, [shard.rank(0)])):
        with pytest.raises(IndexError):
            wrong()
    with pytest.raises(ValueError):
        token_files.Shard(io.BytesIO(b"something else"))


def texts_of_kinds(n=300, seed=4):
    rng = random.Random(seed)
    words = ["the", "Quick", "naïve", "été", "日本語", "word's", "12,5", "😀", "x" * 300, "<|endoftext|>", "é", " "]
    return [None, "", " \n\t ", "a " * 20_000, "z" * 50_000] + [
        "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 60)))
        for _ in range(n)]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_TOKENS", 500)
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts_of_kinds())]
    rows += [(4, "repeated row")] * 30 + [(4, "another text")] + [(None, "no id"), (None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.lit(1).alias("hash"), F.lit(2).alias("row"), F.lit(3).alias("ids"))
    path = f"{checkpoint_dir(spark)}/token-test-{uuid.uuid4().hex}"
    token_files.write_texts(docs.repartition(4), path, WORD_BPE, shard_tokens=2000)
    library = Tokenizer.from_file(WORD_BPE)
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    back = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == want
    assert [r.doc_id for r in back] == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    assert [r.start for r in back] == np.cumsum([0] + [len(r.ids) for r in back])[:-1].tolist()
    digests = {r.start: r for r in token_files.read_digests(spark, path).collect()}
    assert all((d.doc_id, d.n_tokens, d.ids_crc32) == (r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
               for r in back for d in [digests[r.start]]) and len(digests) == len(back)
    counts = Counter(t for r in back for t in r.ids)
    asked = [1, 48_999, *[t for t, _ in counts.most_common(3)], *list(counts)[::40]]
    assert {r.token: r.n for r in token_files.count_tokens(spark, path, asked).collect()} == {t: counts[t] for t in asked}
    places = Counter((r.doc_id, t, p) for r in back for p, t in enumerate(r.ids) if t in asked)
    assert Counter(map(tuple, token_files.find_tokens(spark, path, asked).collect())) == places
    with pytest.raises(FileExistsError):
        token_files.write_texts(docs, path, WORD_BPE)


def test_ids_of_any_frame_are_written_as_they_are(spark):
    path = f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = [(1, [5, 70_000, 5]), (2, []), (3, None), (4, [0])]
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1), path)
    assert [(r.doc_id, r.start, r.ids) for r in token_files.read_tokens(spark, path).collect()] == [
        (1, 0, [5, 70_000, 5]), (2, 3, []), (3, 3, []), (4, 3, [0])]


def test_files_outside_the_manifest_are_not_read(spark):
    path = f"{checkpoint_dir(spark)}/token-stray-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    token_files.write_texts(docs, path, WORD_BPE)
    files, root = token_files._filesystem(path)
    with files.open_output_stream(f"{root}/half.wm") as out:  # what a lost task leaves
        out.write(b"WMTOK")
    assert token_files.read_tokens(spark, path).count() == 2


def test_token_files_of_an_empty_table(spark):
    path = f"{checkpoint_dir(spark)}/token-none-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_texts(docs, path, WORD_BPE)
    assert token_files.read_tokens(spark, path).count() == 0
    assert token_files.count_tokens(spark, path, [1]).count() == 0


def test_token_files_query(spark, sf_small):
    rows = sorted(queries.QUERIES["op12_wavelet_token_files"](spark, sf_small).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(WORD_BPE), 0
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    assert len(rows) == len(docs)
    for r, (i, text) in zip(rows, docs):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
