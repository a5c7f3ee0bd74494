"""Approximate search by largest inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component so that all have norm 1 (queries: 0 there);
the nearest of them in Euclidean distance then are those of largest inner product.  Each table hashes with
``n_functions`` random projections cut into cells.  A query visits, per table, its own bucket and then the
buckets next to it in the order of their estimated success (the squared distances to the cell borders that are
crossed).  How many is calibrated: a bounded sample of queries is searched exactly, and the least number of
probes that finds the wanted share of their true neighbours is taken.  Candidates of all tables are reranked by
their exact inner product.

Buckets are cut into blocks of bounded size on both sides, so a hot bucket is many groups; of equal vectors
only as many as a result can hold are indexed, those with the smallest different ids.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campusflow.llm.near import list_column, mix64
from campusflow.llm.shared import persisted

#: Hash tables, width of a cell, vectors that a bucket should hold, and the range of projections per table.
TABLES, WIDTH, BUCKET, FUNCTIONS = 4, 2.0, 256, (2, 9)
#: Share of true neighbours to find, and the queries (by a hash of their id) on which it is measured.
RECALL, SAMPLE = 0.95, 96
#: Vectors and queries of a block, and queries whose best candidates a task holds at a time.
BLOCK, HELD = 4096, 20_000
SEED = 20240607

ROW = "tbl int, bucket long, id long, x array<double>"


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


@lru_cache(maxsize=8)
def _projections(dims: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, dims + 1, functions) directions and (tables, functions) shifts."""
    rng = np.random.Generator(np.random.PCG64([SEED, dims]))
    return (rng.standard_normal((TABLES, dims + 1, FUNCTIONS[1]))[:, :, :functions],
            rng.uniform(0, 1, (TABLES, FUNCTIONS[1]))[:, :functions])


def _cells(x: np.ndarray, last: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Per table and vector the cell of each function, and where in the cell (0 to 1) it lies."""
    directions, shifts = _projections(x.shape[1], functions)
    place = np.einsum("nd,tdf->tnf", np.column_stack([x, last]), directions) / WIDTH + shifts[:, None, :]
    cell = np.floor(place)
    return cell.astype(np.int64), place - cell


def _bucket(cells: np.ndarray, dims: int) -> np.ndarray:
    """One 64-bit key per row of cells; vectors of different length never share one."""
    key = np.full(cells.shape[:-1], dims, np.uint64)
    for f in range(cells.shape[-1]):
        key = mix64(key ^ (cells[..., f].astype(np.uint64) + np.uint64(f << 32)))
    return key.view(np.int64)


@lru_cache(maxsize=16)
def _perturbations(functions: int) -> np.ndarray:
    return np.array(list(itertools.product((0, 1, -1), repeat=functions)), np.int64)


def _costs(inside: np.ndarray) -> np.ndarray:
    """Per row of positions the squared border distances that each perturbation crosses, summed."""
    moves = _perturbations(inside.shape[-1])
    up, down = (moves == 1).astype(float), (moves == -1).astype(float)
    return (1 - inside) ** 2 @ up.T + inside ** 2 @ down.T


def _arrays(batch: pa.RecordBatch):
    """(ids, vectors) of a batch, one pair per vector length."""
    lists = batch.column("x")
    offsets = lists.offsets.to_numpy()
    values, ids = lists.values.to_numpy(), batch.column("id").to_numpy()
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], values[offsets[rows][:, None] + np.arange(n)], rows


def _batch(table: int, keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), table, np.int32)), pa.array(keys), pa.array(ids),
                                       list_column(x)], ["tbl", "bucket", "id", "x"])


def _index(functions: int, norm: float):
    def index(batches):
        for batch in batches:
            for ids, x, _ in _arrays(batch):
                scaled = x / norm
                last = np.sqrt(np.maximum(0.0, 1 - (scaled ** 2).sum(axis=1)))
                cells, _ = _cells(scaled, last, functions)
                for t, keys in enumerate(_bucket(cells, x.shape[1])):
                    yield _batch(t, keys, ids, x)
    return index


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _probe(functions: int, probes: int):
    def probe(batches):
        moves = _perturbations(functions)
        for batch in batches:
            for all_ids, all_x, _ in _arrays(batch):
                for low in range(0, len(all_ids), 64):
                    ids, x = all_ids[low: low + 64], all_x[low: low + 64]
                    cells, inside = _cells(_unit(x), np.zeros(len(x)), functions)
                    for t in range(TABLES):
                        order = np.argsort(_costs(inside[t]), axis=1, kind="stable")[:, :probes]
                        keys = _bucket(cells[t][:, None, :] + moves[order], x.shape[1])
                        each = np.repeat(np.arange(len(ids)), keys.shape[1])
                        yield _batch(t, keys.reshape(-1), ids[each], x[each])
    return probe


def _kth_id(scores: np.ndarray, ids: np.ndarray, q_id: int, k: int) -> float:
    """The score of the k-th best different id other than the query's; no bound where there are fewer."""
    wanted = k + 1
    while wanted < len(scores):
        bound = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
        others = ids[(scores >= bound) & (ids != q_id)]
        if len(others) >= k and len(np.unique(others)) >= k:
            return bound
        wanted *= 4  # rows that repeat an id took the places
    return -np.inf


def _exact(best: dict, k: int, queries: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray]) -> None:
    """Merge the vectors' best k for each query into ``best``: query id -> (scores, ids), best first."""
    q_ids, q = queries
    v_ids, v = vectors
    rough = q @ v.T
    most = rough.max(axis=1)
    for i, q_id in enumerate(q_ids.tolist()):
        held = best.get(q_id)
        slack = 1e-9 * (1 + abs(most[i]))
        floor = held[0][-1] if held is not None and len(held[0]) >= k else -np.inf
        if most[i] < floor - slack:
            continue
        scores = rough[i]
        if len(scores) > k + 1:
            floor = max(floor, _kth_id(scores, v_ids, q_id, k))
        rows = np.flatnonzero((scores >= floor - slack) & (v_ids != q_id))
        score = (v[rows] * q[i]).sum(axis=1)  # the same for equal vectors wherever they stand
        ids = v_ids[rows]
        if held is not None:
            score, ids = np.concatenate([score, held[0]]), np.concatenate([ids, held[1]])
        order = np.lexsort((ids, -score))
        _, first = np.unique(ids[order], return_index=True)  # tables give a vector more than once
        order = order[np.sort(first)][:k]
        best[q_id] = (score[order], ids[order])


def _emit(best: dict) -> pa.RecordBatch:
    sizes = [len(s) for s, _ in best.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(list(best), np.int64), sizes)),
         pa.array(np.concatenate([i for _, i in best.values()] or [np.zeros(0, np.int64)]).astype(np.int64)),
         pa.array(np.concatenate([s for s, _ in best.values()] or [np.zeros(0)]).astype(np.float64))],
        ["query_id", "vec_id", "score"])


def _rerank(k: int):
    def rerank(batches):
        best: dict = {}
        block, held = None, []  # the vectors of the block at hand come before its queries
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("tbl", "bucket", "v_block", "q_block", "side")]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                key = tuple(int(c[low]) for c in columns)
                if key[:4] != block:
                    block, held = key[:4], []
                part = [(ids, x) for ids, x, _ in _arrays(batch.slice(low, high - low))]
                if key[4] == 0:
                    held += part
                    continue
                if len(held) > 1:
                    by_length: dict = {}
                    for ids, x in held:
                        by_length.setdefault(x.shape[1], []).append((ids, x))
                    held = [(np.concatenate([i for i, _ in p]), np.concatenate([x for _, x in p]))
                            for p in by_length.values()]
                for queries in part:
                    for vectors in held:
                        if queries[1].shape[1] == vectors[1].shape[1]:
                            _exact(best, k, queries, vectors)
                if len(best) > HELD:
                    yield _emit(best)
                    best = {}
        yield _emit(best)
    return rerank


def _scan(sample: list[tuple[int, np.ndarray]], k: int):
    """Exact search of a few queries over a partition, with the neighbours' vectors."""
    def scan(batches):
        best: dict = {}
        vectors: dict = {}
        for batch in batches:
            for ids, x, _ in _arrays(batch):
                for q_id, q in sample:
                    if len(q) == x.shape[1]:
                        _exact(best, k, (np.array([q_id]), q[None, :]), (ids, x))
                wanted = {i for _, found in best.values() for i in found.tolist()}
                vectors = {i: v for i, v in vectors.items() if i in wanted}
                vectors.update({i: x[n] for n, i in enumerate(ids.tolist()) if i in wanted})
        rows = [(q, i, s, vectors[i].tolist()) for q, (score, found) in best.items()
                for s, i in zip(score.tolist(), found.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], ["query_id", "vec_id", "score", "x"])
    return scan


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def calibrate(vectors: DataFrame, queries: DataFrame, k: int, norm: float, functions: int,
              recall: float = RECALL) -> tuple[int, int]:
    """(functions, probes) that find ``recall`` of the sampled queries' true neighbours; fewer functions
    where even all neighbouring buckets would not, none at all meaning one bucket."""
    sample = [(r["id"], np.array(r["x"])) for r in
              queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]  # bounded by SAMPLE
    schema = "query_id long, vec_id long, score double, x array<double>"
    near = _top(vectors.mapInArrow(_scan(sample, k), schema), k).collect() if sample else []  # k per sampled query
    vector_of = dict(sample)
    while functions:
        ranks = []
        for r in near:
            q, x = _unit(vector_of[r["query_id"]][None, :]), np.array(r["x"])[None, :] / norm
            own, inside = _cells(q, np.zeros(1), functions)
            cells, _ = _cells(x, np.sqrt(np.maximum(0.0, 1 - (x ** 2).sum(axis=1))), functions)
            moves = _perturbations(functions)
            costs = np.stack([_costs(inside[t])[0] for t in range(TABLES)])
            step = (cells - own)[:, 0, :]
            rank = len(moves)
            for t in range(TABLES):
                if (np.abs(step[t]) <= 1).all():
                    at = int(np.flatnonzero((moves == step[t]).all(axis=1))[0])
                    order = np.argsort(costs[t], kind="stable")
                    rank = min(rank, int(np.flatnonzero(order == at)[0]))
            ranks.append(rank)
        ranks.sort()
        need = ranks[math.ceil(recall * len(ranks)) - 1] + 1 if ranks else 1
        if need <= 3 ** functions:
            return functions, need
        functions -= 1
    return 0, 1


def _reranked(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of the vectors that share a table's bucket with a query."""
    key = ["tbl", "bucket"]
    blocks = (stored.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks"))
              .join(asked.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), key)
              .select(F.col("tbl").alias("t"), F.col("bucket").alias("b"), "v_blocks", "q_blocks"))
    blocks = persisted(blocks)

    def placed(rows, side, own, other):
        at = rows.join(blocks, (F.col("tbl") == F.col("t")) & (F.col("bucket") == F.col("b")))
        return at.select(*key, F.pmod(F.xxhash64("id"), F.col(f"{own}s").cast("long")).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other),
                         F.lit(side).alias("side"), "id", "x")

    group = [*key, "v_block", "q_block"]
    both = placed(stored, 0, "v_block", "q_block").unionByName(placed(asked, 1, "q_block", "v_block"))
    return both.repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(
        _rerank(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's ``k`` candidates of largest inner product found.

    ``is_query`` is a condition on ``id_col``.  Candidates are all rows with another id, ties go to the smaller
    id.  Vectors that are null, empty, zero or hold null or non-finite components and rows without an id take
    no part; vectors of another length than the query's are no candidates of it; rows that repeat an id are one
    candidate, with the best of their scores.  Other columns are ignored; an empty table gives no rows.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    valid = persisted(vectors.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x"), is_query.alias("asks")).filter(usable(F.col("x"))))
    copies = Window.partitionBy("x").orderBy("id")
    index = persisted(valid.select("id", "x").distinct().withColumn("copy", F.row_number().over(copies))
                      .filter(F.col("copy") <= k + 1).drop("copy"))
    queries = valid.filter("asks").select("id", "x")
    size = index.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "x", F.lit(0.0), lambda a, c: a + c * c)).alias("square")).first()
    norm = math.sqrt(size["square"]) * (1 + 1e-12) if size["n"] else 1.0
    # a projection cut at WIDTH tells apart about two to the power of 1.5 cells
    functions = round(math.log2(max(size["n"], 1) / BUCKET) / 1.5) if size["n"] > BUCKET else 0
    functions, probes = calibrate(index, queries, k, norm, min(max(functions, FUNCTIONS[0]), FUNCTIONS[1]), recall)
    stored = persisted(index.mapInArrow(_index(functions, norm), ROW))
    asked = persisted(queries.mapInArrow(_probe(functions, probes), ROW))
    merged = persisted(_best(_reranked(stored, asked, k)))
    # queries whose buckets held too few are searched against all vectors of their length
    each = index.groupBy(F.size("x").alias("length")).agg((F.count_distinct("id") - 1).alias("others"))
    wanted = (queries.select("id", F.size("x").alias("length")).distinct().join(each, "length")
              .groupBy("id").agg(F.least(F.sum("others"), F.lit(k)).alias("wanted")))
    counts = merged.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"))
    short = persisted(wanted.join(counts, F.col("id") == F.col("q"), "left")
                      .filter(F.coalesce("n", F.lit(0)) < F.col("wanted")).select(F.col("id").alias("s")))
    if not short.isEmpty():
        place = [F.lit(-1).alias("tbl"), F.size("x").cast("long").alias("bucket"), "id", "x"]
        again = queries.join(short, F.col("id") == F.col("s"), "left_semi").select(*place)
        merged = _best(merged.unionByName(_reranked(index.select(*place), again, k)))
    return _top(merged, k).select("query_id", "rank", "vec_id", "score")
