"""Centroid clustering of integer vectors by bit planes and popcounts.

The integers of a vector are kept as bit planes in two's complement: plane b holds bit b of each component, 64
components to an unsigned 64-bit word.  With plane weights w (powers of two, the sign plane's negative) the dot
product of a vector and a centroid is the sum of w[i] * w[j] * popcount(vector plane i AND centroid plane j), which
is exact, and the squared distance follows from it and the two squared lengths.  Planes are packed once; every
round reads them, adds up the components of each cluster in its tasks, and sends only those sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.integer_vectors import integer_rows, smallest_vectors
from campusflow.llm.near import binary_column
from campusflow.llm.shared import persisted

DIMS, CENTROIDS, ROUNDS = 64, 40, 5
#: Vectors whose distances are computed at a time.
CHUNK = 4096
WORD = 64


def pack_planes(ints: np.ndarray) -> np.ndarray:
    """(rows, planes, words) uint64 of (rows, dims) integers, with as many planes as the largest of them needs."""
    n, dims = ints.shape
    most = int(np.where(ints < 0, ~ints, ints).max(initial=0))
    planes, words = most.bit_length() + 1, -(-dims // WORD)
    out = np.empty((n, planes, words), np.uint64)
    padded = np.zeros((n, words * WORD), np.uint8)
    for b in range(planes):
        padded[:, :dims] = (ints >> b) & 1
        out[:, b] = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    return out


def weights(planes: int) -> np.ndarray:
    """What each plane counts: powers of two, the sign plane's negative."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpack_planes(packed: np.ndarray, dims: int) -> np.ndarray:
    """(rows, dims) integers again."""
    n, planes, words = packed.shape
    out = np.zeros((n, dims), np.int64)
    for b, w in enumerate(weights(planes).tolist()):
        raw = np.ascontiguousarray(packed[:, b]).astype("<u8").view(np.uint8)
        out += np.unpackbits(raw.reshape(n, -1), axis=1, bitorder="little")[:, :dims].astype(np.int64) * w
    return out


def dot_products(packed: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, centroids) exact dot products from packed planes of both."""
    vectors = np.ascontiguousarray(packed.transpose(1, 2, 0))  # plane, word, row
    own, theirs = weights(packed.shape[1]), weights(centroids.shape[1]).tolist()
    out = np.empty((packed.shape[0], len(centroids)), np.int64)
    both, counts = np.empty_like(vectors[:, 0]), np.empty(vectors[:, 0].shape, np.int64)
    for c, planes in enumerate(centroids):
        total = np.zeros(vectors[:, 0].shape, np.int64)
        for w, words in zip(theirs, planes):
            for i, word in enumerate(words):
                if word:
                    np.bitwise_and(vectors[:, i], word, out=both)
                    np.multiply(np.bitwise_count(both), np.int64(w), out=counts)
                    total += counts
        out[:, c] = own @ total
    return out


def nearest(packed: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid (rows of integers), ties to the smaller number."""
    planes, length = pack_planes(centroids), (centroids ** 2).sum(axis=1)
    distance = square[:, None] - 2 * dot_products(packed, planes) + length[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _pack(dims: int):
    def pack(batches):
        for batch in batches:
            for rows, ints in integer_rows(batch.column("x")):
                if ints.shape[1] == dims:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id").take(pa.array(rows)), binary_column(pack_planes(ints).reshape(len(rows), -1)),
                         pa.array((ints ** 2).sum(axis=1))], ["vec_id", "planes", "square"])
    return pack


def _chunks(batches, dims: int):
    """(batch, rows, packed planes, squares) of rows with as many planes each."""
    words = -(-dims // WORD)
    for batch in batches:
        blob = batch.column("planes")
        offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset: blob.offset + len(blob) + 1]
        data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)
        square, sizes = batch.column("square").to_numpy(), np.diff(offsets)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for low in range(0, len(rows), CHUNK):
                part = rows[low: low + CHUNK]
                raw = data[offsets[part][:, None] + np.arange(size)]
                yield batch, part, raw.view("<u8").reshape(len(part), -1, words), square[part]


def _sums(centroids: np.ndarray):
    """Per task one row for each component of each cluster: how many vectors it has and their sum."""
    def add(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, _, packed, square in _chunks(batches, centroids.shape[1]):
            cluster, _ = nearest(packed, square, centroids)
            order = np.argsort(cluster, kind="stable")
            found, first, times = np.unique(cluster[order], return_index=True, return_counts=True)
            total[found] += np.add.reduceat(unpack_planes(packed, centroids.shape[1])[order], first, axis=0)
            count[found] += times
        cluster, position = (x.reshape(-1) for x in np.indices(total.shape))
        times = np.repeat(count, total.shape[1])
        used = times > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster[used].astype(np.int32)), pa.array(position[used].astype(np.int32)),
             pa.array(total.reshape(-1)[used]), pa.array(times[used])], ["cluster", "position", "total", "n"])
    return add


def _assign(centroids: np.ndarray):
    def assign(batches):
        for batch, rows, packed, square in _chunks(batches, centroids.shape[1]):
            cluster, distance = nearest(packed, square, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"])
    return assign


def packed_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id, planes (binary) and square (squared length) of the vectors with ``dims`` finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    return rows.mapInArrow(_pack(dims), "vec_id long, planes binary, square long")


def digest_order(id_col: Column) -> Column:
    """The start order of the vectors: the lower-case hex SHA-256 of ``2:<id>``."""
    return F.sha2(F.concat(F.lit("2:"), id_col.cast("long").cast("string")), 256)


def train(packed: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(centroids, dims) integers after ``rounds``: each assigns every vector to the nearest centroid and moves the
    centroid to the floor of its vectors' mean; empty ones stay."""
    centroids = start.copy()
    for _ in range(rounds):
        sums = packed.mapInArrow(_sums(centroids), "cluster int, position int, total long, n long")
        moved = sums.groupBy("cluster", "position").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in moved.collect():  # one row per component of a centroid
            centroids[r["cluster"], r["position"]] = int(r["total"]) // r["n"]
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
            n_centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 per vector.

    Vectors that are null, of another length than ``dims`` or hold null or non-finite components take no part.
    Centroids start as the vectors with the smallest digests of different ids (fewer, if there are fewer; rows
    without an id come last; of a repeated id the least vector).  Rows that repeat an id are clustered each.  Sums
    that do not fit a long are null.  Other columns are ignored; an empty table gives no rows.
    """
    packed = persisted(packed_vectors(vectors, id_col, vector_col, dims))
    keyed = vectors.select(digest_order(F.col(id_col)).alias("key"), F.col(vector_col).alias("x"))
    start = smallest_vectors(keyed, n_centroids, lambda n: n == dims).get(dims, np.zeros((0, dims), np.int64))
    schema = "vec_id long, cluster int, distance long"
    if not len(start):
        return vectors.sparkSession.createDataFrame(
            [], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = train(packed, start, rounds)
    assigned = persisted(packed.mapInArrow(_assign(centroids), schema))
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row per centroid
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(c, fits(inertia.get(c, 0)), fits(sum(inertia.values())),
             hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = vectors.sparkSession.createDataFrame(rows, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
