"""Product codes of vectors, every nearest codebook entry found by Orchard's search.

A vector's integers are cut into ``parts`` equal consecutive parts, and each part position has a codebook of its
own.  A codebook keeps, for every entry, the list of all entries by their distance from it.  A search starts at a
near pivot and walks down the list of the best entry so far; as soon as an entry is better it jumps to that entry's
list.  Entries already compared are marked and not compared again, and a list is left for good where its entries
are farther from the best one than twice the best distance, since by the triangle inequality none of them can be
nearer.  The result is exact, ties to the lower index included.

Searches run batch-wise: all parts of all vectors of a chunk walk their lists at the same time.  A round of training
is one pass in which tasks add up the parts of each entry; only these sums leave them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.integer_vectors import integer_rows, smallest_vectors
from campusflow.llm.shared import persisted

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors searched at a time, and labels up to which their totals are broadcast.
CHUNK, BROADCAST_LABELS = 1024, 10_000


class Orchard:
    """Exact nearest entries of several codebooks of the same size: ``entries`` is (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n_parts, k, _ = entries.shape
        apart = np.empty((n_parts, k, k), np.int64)
        for p in range(n_parts):
            apart[p] = ((entries[p][:, None, :] - entries[p][None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=2, kind="stable").reshape(-1, k)
        # four times the squared best distance is the square of twice the distance
        self.reach = np.take_along_axis(apart.reshape(-1, k), self.lists, axis=1)
        self.flat = entries.reshape(n_parts * k, -1)
        self.pivots = math.isqrt(k - 1) + 1 if k > 1 else 1

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance), each (rows, parts), for points (rows, parts, width)."""
        n, n_parts, width = points.shape
        k = self.entries.shape[1]
        points = points.reshape(n * n_parts, width)
        base = np.tile(np.arange(n_parts) * k, n)
        visited = np.zeros((len(points), k), bool)
        best, least = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for e in range(self.pivots):  # the first entries are the pivots, from the nearest of which the walk starts
            d = ((points - self.flat[base + e]) ** 2).sum(axis=1)
            closer = d < least
            best[closer], least[closer] = e, d[closer]
            visited[:, e] = True
        rows, at = np.arange(len(points)), np.zeros(len(points), np.int64)
        while len(rows):
            start = base[rows] + best[rows]
            step = at[rows]
            near = self.reach[start, step] <= 4 * least[rows]
            rows, step, start = rows[near], step[near], start[near]
            entry = self.lists[start, step]
            at[rows] += 1
            fresh = np.flatnonzero(~visited[rows, entry])
            which, entry = rows[fresh], entry[fresh]
            visited[which, entry] = True
            d = ((points[which] - self.flat[base[which] + entry]) ** 2).sum(axis=1)
            closer = (d < least[which]) | ((d == least[which]) & (entry < best[which]))
            jump = which[closer]
            best[jump], least[jump], at[jump] = entry[closer], d[closer], 0
            rows = rows[at[rows] < k]
        return best.reshape(n, n_parts), least.reshape(n, n_parts)


def _assigned(batches, codebooks: dict[int, np.ndarray]):
    """(batch, rows, points, index, distance) per chunk of rows of one length that has a codebook."""
    searches = {n: Orchard(c) for n, c in codebooks.items()}
    for batch in batches:
        for rows, ints in integer_rows(batch.column("x")):
            search = searches.get(ints.shape[1])
            for low in range(0, len(rows) if search else 0, CHUNK):
                points = ints[low: low + CHUNK].reshape(-1, search.entries.shape[0], search.entries.shape[2])
                yield batch, rows[low: low + CHUNK], points, *search.search(points)


def _sums(codebooks: dict[int, np.ndarray]):
    """Per task one row for each component of each entry: how many parts it has and their sum."""
    def add(batches):
        total = {n: np.zeros(c.shape, np.int64) for n, c in codebooks.items()}
        count = {n: np.zeros(c.shape[:2], np.int64) for n, c in codebooks.items()}
        for _, _, points, index, _ in _assigned(batches, codebooks):
            n = points.shape[1] * points.shape[2]
            for p in range(points.shape[1]):
                order = np.argsort(index[:, p], kind="stable")
                found, first, times = np.unique(index[order, p], return_index=True, return_counts=True)
                total[n][p, found] += np.add.reduceat(points[order, p], first, axis=0)
                count[n][p, found] += times
        for n, sums in total.items():
            part, entry, position = (x.reshape(-1) for x in np.indices(sums.shape))
            times = np.repeat(count[n].reshape(-1), sums.shape[2])
            used = times > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(used.sum()), n, np.int32))]
                + [pa.array(x[used].astype(np.int32)) for x in (part, entry, position)]
                + [pa.array(sums.reshape(-1)[used]), pa.array(times[used])],
                ["dims", "part", "entry", "position", "total", "n"])
    return add


def _rows(vectors: DataFrame, vector_col: str, *others: Column) -> DataFrame:
    return vectors.select(*others, F.col(vector_col).alias("x"))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """{vector length: (parts, entries, width) codebooks}, fitted on all vectors.

    A codebook starts as its part of the vectors with the ``entries`` smallest different ids (fewer, if there are
    fewer; rows without an id come last; of a repeated id the least vector).  A round assigns every part to its
    nearest entry and moves the entry to the floor of its parts' mean; unused entries stay.  Vectors that are null,
    empty or hold null or non-finite components take no part, nor do lengths that ``parts`` does not divide; each
    length has codebooks of its own.  An empty table gives none.  ``vectors`` is read once per round and once before.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index of two hex digits has at most 256 entries")
    first = smallest_vectors(_rows(vectors, vector_col, F.col(id_col).cast("long").alias("key")), entries,
                             lambda dims: dims % parts == 0)
    codebooks = {n: np.ascontiguousarray(v.reshape(len(v), parts, n // parts).transpose(1, 0, 2))
                 for n, v in first.items()}
    if not codebooks:
        return {}
    x = _rows(vectors, vector_col)
    for _ in range(rounds):
        sums = x.mapInArrow(_sums(codebooks), "dims int, part int, entry int, position int, total long, n long")
        moved = sums.groupBy("dims", "part", "entry", "position").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        codebooks = {n: c.copy() for n, c in codebooks.items()}
        for r in moved.collect():  # one row per component of a codebook
            codebooks[r["dims"]][r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return codebooks


def _encode(codebooks: dict[int, np.ndarray]):
    digits = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches):
        for batch, rows, _, index, distance in _assigned(batches, codebooks):
            at = pa.array(rows)
            pairs = np.ascontiguousarray(digits[index])
            codes = pairs.view(f"<U{2 * index.shape[1]}").reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(codes.tolist(), pa.string()),
                 pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])
    return encode


def encode(vectors: DataFrame, codebooks: dict[int, np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits per part, in part order) and error (squared distance from the decoded
    vector) per row whose vector has a codebook; rows are coded each, whatever their id."""
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = _rows(vectors, vector_col, F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"))
    return rows.mapInArrow(_encode(codebooks), f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, codebook: np.ndarray, code_col: str = "code") -> DataFrame:
    """``codes`` with ``decoded`` (array<bigint>): the integers that each code of this length's codebook stands for."""
    n_parts, n_entries, width = codebook.shape
    flat = F.lit(codebook.reshape(-1).tolist()).cast("array<bigint>")

    def part(p):
        at = F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
        return F.slice(flat, (at + p * n_entries) * width + 1, width)
    return codes.withColumn("decoded", F.concat(*[part(p) for p in range(n_parts)]))


def codebooks_digest(codebooks: dict[int, np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position; shorter vectors' codebooks first."""
    text = ",".join(str(x) for n in sorted(codebooks) for x in codebooks[n].reshape(-1).tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 per vector, persisted.

    ``label_error`` sums the errors of the rows with an equal label, null being one.  Which vectors take part, ties
    and repeated ids: see ``train``.  Other columns are ignored; an empty table gives no rows.
    """
    codebooks = train(vectors, id_col, vector_col, parts, entries, rounds)
    coded = persisted(encode(vectors, codebooks, id_col, vector_col, label_col))
    # one row per label, whatever its rows; the sum is exact and null where it does not fit a long
    labels = persisted(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
                       .select(F.col("label").alias("of"), F.expr("try_cast(total AS bigint)").alias("label_error")))
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
