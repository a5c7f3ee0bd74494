"""Near-duplicate search by MinHash, shared by the line dedup and the n-gram join.

1. ``min_hashes``/``band_keys``: signatures of shingle sets, computed batch-wise in numpy inside tasks.
2. ``candidate_components``: nodes that share a band are candidates.  A bucket's members are compared by
   their sketches (one byte per hash), which removes chance collisions, and only a spanning forest of what
   remains leaves the bucket; a bucket is cut into blocks of about ``BUCKET_BLOCK`` members, and every pair of
   blocks is compared on its own.
3. ``verified_links``: each candidate component is cut into blocks of bounded size, every block and every pair of
   blocks is one group, and all pairs of its rows are verified on their full shingle sets there.  Only link counts and
   a spanning forest leave the group, never the pairs.  Pairs of blocks come in passes, as a text goes to as many of
   them as its component has blocks: a pass places about as much text as all components hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.shared import connected_components, persisted

#: Members of a block of a bucket.
BUCKET_BLOCK = 2048
#: Members up to which the buckets of one size are compared at once.
SMALL_BUCKET = 16
#: Rows and shingles (estimated by payload characters) of a verification block.
BLOCK_ROWS, BLOCK_CHARS = 512, 4_000_000
#: Characters that a pass over pairs of blocks may place, should all components hold fewer.
PASS_CHARS = 1 << 26
#: Bits of a shingle's hash that are compared, and texts whose numbers fit the rest.
SHINGLE_BITS, MOST_OWNERS = 52, 1 << 12
#: Elements hashed at a time, and columns of the incidence matrix.
CHUNK, COLUMNS = 1 << 16, 8192
#: Passes that spread shingles over the places of a signature, and shingles spread at a time.
SPREADS, SPREAD = 8, 1 << 15

_U64 = np.uint64


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(rows, bands): the most rows whose bands reach ``recall`` at ``threshold`` within the hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows)))
        if rows * bands <= max_hashes:
            best = (rows, bands)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift rounds."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser of the same kind, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U64(salt << 32)) * _U64(0x9E3779B97F4A7C15))


def hash_strings(values: pa.Array, key: str = "0123456789123456") -> np.ndarray:
    """64-bit hash per string."""
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False, hash_key=key)


def word_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashed n-grams of each text's words one text after the other, and how many each has.

    A text of one to n-1 words has one shingle, all its words; a blank or null one has none.
    """
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    hashed = hash_strings(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    # blank texts split into nothing or into one empty word
    n_words = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    counts = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    starts = offsets[:-1] - offsets[0]
    padded = np.concatenate([hashed, np.zeros(n, np.uint64)])
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    length = np.repeat(np.minimum(n_words, n), counts)
    chain = padded[at]
    for k in range(1, n):
        longer = mix64(chain * _U64(0x9E3779B97F4A7C15) + padded[at + k])
        chain = np.where(length > k, longer, chain)
    return mix64(chain + length.astype(np.uint64)), counts


def char_shingles(texts: pa.Array, n: int, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashed n-byte windows of each text's UTF-8; a shorter text is one shingle, an empty one none.

    Windows double in length, and those of the binary digits of ``n`` are joined.  Signatures do with ``np.uint32``
    hashes, which are cheaper.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    part, width = np.concatenate([data, np.zeros(n, np.uint8)]).astype(kind), 1
    rolled, done = None, 0
    while width <= n:
        factor = kind(pow(0x01000193, width, 1 << 32))
        if n & width and rolled is None:
            rolled, done = part.copy(), width
        elif n & width:
            rolled[:-done] = rolled[:-done] * factor + part[done:]
            done += width
        part[:-width] = part[:-width] * factor + part[width:]
        width *= 2
    valid = np.ones(len(data), bool)
    for back in range(1, n):  # starts too close to their text's end
        at = offsets[1:] - back
        valid[at[(sizes >= back) & ((sizes >= n) | (back < sizes))]] = False
    hashes = rolled[: len(data)][valid]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    firsts = (np.cumsum(counts) - counts)[short]
    for i, place in zip(short.tolist(), firsts.tolist()):  # shorter texts: their own bytes only
        value = int(sizes[i])
        for byte in data[offsets[i]: offsets[i + 1]].tolist():
            value = value * 1009 + byte + 1
        hashes[place] = value % (1 << 8 * hashes.itemsize)
    return (mix64 if kind is np.uint64 else mix32)(hashes + kind(1)), counts


def text_ids(texts: pa.Array) -> np.ndarray:
    """(texts, 2) uint64: a 128-bit id of each text as it is."""
    values = texts.to_numpy(zero_copy_only=False).astype(object)
    return np.column_stack([pd.util.hash_array(values, categorize=False, hash_key=key)
                            for key in ("0123456789123456", "6543210987654321")])


def min_hashes(shingles: np.ndarray, counts: np.ndarray, n_hashes: int) -> np.ndarray:
    """(texts, n_hashes) uint32 minima; texts without shingles keep the largest value."""
    x = shingles if shingles.dtype == np.uint32 else (shingles >> _U64(32)).astype(np.uint32)
    filled = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[filled]
    out = np.full((n_hashes, len(filled)), 0xFFFFFFFF, np.uint32)
    salts, factors = seeds(n_hashes, 1).astype(np.uint32), seeds(n_hashes, 2).astype(np.uint32) | np.uint32(1)
    for low in range(0, len(x), CHUNK):
        part = x[low: low + CHUNK]
        first, last = np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, low + len(part), "left")
        cuts, held, buffer = np.maximum(starts[first:last] - low, 0), out[:, first:last], np.empty_like(part)
        for j in range(n_hashes):
            np.bitwise_xor(part, salts[j], out=buffer)
            np.multiply(buffer, factors[j], out=buffer)
            np.minimum(held[j], np.minimum.reduceat(buffer, cuts), out=held[j])
    full = np.full((len(counts), n_hashes), 0xFFFFFFFF, np.uint32)
    full[filled] = out.T
    return full


def spread_min_hashes(shingles: np.ndarray, counts: np.ndarray, n_hashes: int) -> np.ndarray:
    """(texts, n_hashes) uint32 minima as of ``min_hashes``, for ``np.uint32`` shingles: each is equal in two texts with
    the probability of their similarity, and the number of equal ones varies less (fast similarity sketches).

    In each of SPREADS passes a shingle is hashed once, into one place; a later pass only fills what is empty, as its
    values are larger.  What is empty after them gets the minimum of a hash of its own.  A text of many shingles takes
    few passes.
    """
    out, ends = np.empty((len(counts), n_hashes), np.uint32), np.cumsum(counts)
    cuts = _runs((ends - counts) // SPREAD) if len(counts) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # arrays that stay in the cache
        out[a:b] = _spread(shingles[ends[a] - counts[a]: ends[b - 1]], counts[a:b], n_hashes)
    return out


def _mixed(x: np.ndarray, salts) -> np.ndarray:
    x = x ^ salts
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def _spread(x: np.ndarray, counts: np.ndarray, n_hashes: int) -> np.ndarray:
    free, places = np.uint32(0xFFFFFFFF), np.arange(len(counts), dtype=np.int64) * n_hashes
    out, salts = np.full(len(counts) * n_hashes, free, np.uint32), seeds(SPREADS + n_hashes, 5).astype(np.uint32)
    left, first, texts = x, np.repeat(places, counts), np.flatnonzero(counts)
    for r in range(SPREADS):
        value = _mixed(left, salts[r]) if r else x.copy()  # shingles come mixed
        place = value >> np.uint32(20)
        place *= np.uint32(n_hashes)
        place >>= np.uint32(12)
        value &= np.uint32(0xFFFFF)
        value |= np.uint32(r << 20)
        np.minimum.at(out, first + place, value)
        wanting = (out.reshape(-1, n_hashes)[texts] == free).any(axis=1)
        if not wanting.all():
            kept = np.repeat(wanting, counts[texts])
            left, first, texts = left[kept], first[kept], texts[wanting]
    starts, empty = np.cumsum(counts) - counts, np.flatnonzero(out == free)
    empty = empty[counts[empty // n_hashes] > 0]
    each = counts[empty // n_hashes]
    slot = (np.cumsum(each) - each) // (8 * SPREAD)
    cuts = _runs(slot) if len(empty) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        text, n = empty[a:b] // n_hashes, each[a:b]
        begin = np.cumsum(n) - n
        at = np.repeat(starts[text] - begin, n) + np.arange(n.sum())
        out[empty[a:b]] = np.minimum.reduceat(_mixed(x[at], np.repeat(salts[SPREADS:][empty[a:b] % n_hashes], n)), begin)
    return out.reshape(-1, n_hashes)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) int64: one bucket key per band."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b, salt in enumerate(seeds(bands, 3)):
        key = np.full(len(signatures), salt, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = mix64(key ^ signatures[:, r])
        keys[:, b] = key
    return keys.view(np.int64)


def set_ids(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 2) uint64: a 128-bit id of each text's bag of shingles, whatever their order; zero without any."""
    out = np.zeros((len(counts), 2), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = (np.cumsum(counts) - counts)[filled]
        # the shingles are well mixed: two sums of them, one of a product that is no linear function of the other
        out[filled, 0] = np.add.reduceat(shingles, starts)
        out[filled, 1] = np.add.reduceat((shingles ^ (shingles >> _U64(32))) * (shingles | _U64(1)), starts)
    return out


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a text column, so that what is computed per byte stays small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def binary_column(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d array."""
    if not len(rows):
        return pa.array([], pa.binary())
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1]), len(rows), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component in a symmetric boolean matrix."""
    labels = np.arange(len(linked))
    while True:
        lower = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(axis=1))
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _forests(linked: np.ndarray) -> np.ndarray:
    """``_forest`` of many matrices of one size."""
    n = linked.shape[1]
    labels = np.broadcast_to(np.arange(n), linked.shape[:2])
    while True:
        lower = np.minimum(labels, np.where(linked, labels[:, None, :], n).min(axis=2))
        lower = np.take_along_axis(lower, lower, 1)
        if (lower == labels).all():
            return labels
        labels = lower


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def quarters(signatures: np.ndarray, size: int) -> np.ndarray:
    """(texts, size / 32) uint64: the lowest two bits of each text's first ``size`` hashes."""
    four = np.ascontiguousarray(signatures[:, :size], np.uint8).view("<u4") & np.uint32(0x03030303)
    four |= (four >> np.uint32(6)) | (four >> np.uint32(12)) | (four >> np.uint32(18))  # the lowest byte has those of all
    return four.astype(np.uint8).view(np.uint64)


def equal_quarters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many hashes two sketches of ``quarters`` are equal."""
    out = None
    for word in range(a.shape[-1]):  # sums along a short axis are slow
        other = a[..., word] ^ b[..., word]
        other |= other >> _U64(1)
        other &= _U64(0x5555555555555555)
        different = np.bitwise_count(other)
        out = different.astype(np.int32) if out is None else np.add(out, different, out=out)
    return 32 * a.shape[-1] - out


def spanning_edges(cuts: np.ndarray, nodes: np.ndarray, sketches: np.ndarray, limit: float, equal: Callable) -> np.ndarray:
    """(edges, 2): spanning edges of the similar sketches in each run that ``cuts`` bounds; members are distinct."""
    sizes = np.diff(cuts)
    first = cuts[:-1][sizes == 2]  # most buckets are pairs: all at once
    alike = first[equal(sketches[first], sketches[first + 1]) >= limit]
    out = [np.column_stack([nodes[alike], nodes[alike + 1]])]
    for size in range(3, SMALL_BUCKET + 1):  # and nearly all others are small: those of one size at once
        starts = cuts[:-1][sizes == size]
        step = max(1, (1 << 22) // (size * size * sketches.shape[1]))
        for some in (starts[i: i + step] for i in range(0, len(starts), step)):
            rows = some[:, None] + np.arange(size)
            own = sketches[rows]
            root = _forests(equal(own[:, :, None, :], own[:, None, :, :]) >= limit)
            moved = root != np.arange(size)
            out.append(np.column_stack([nodes[rows[moved]], nodes[np.take_along_axis(rows, root, 1)[moved]]]))
    for low, size in zip(cuts[:-1][sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
        own, same = sketches[low: low + size], np.empty((size, size), bool)
        step = max(1, (1 << 16) // size)
        for i in range(0, size, step):  # as many members at a time as stay in the cache
            same[i: i + step] = equal(own[i: i + step, None, :], own[None, :, :]) >= limit
        root = _forest(same)
        moved = np.flatnonzero(root != np.arange(size))
        out.append(np.column_stack([nodes[low + moved], nodes[low + root[moved]]]))
    return np.concatenate(out)


def _bucket_edges(limit: float, packed: bool = False) -> Callable:
    """Spanning edges of each bucket's similar sketches, for partitions sorted by key with distinct members;
    ``packed``: sketches are those of ``quarters``."""
    def within(keys, nodes, sketches):
        pairs = spanning_edges(_runs(keys), nodes, sketches, limit, equal_quarters if packed else _equal_bytes)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def edges(batches):
        held = None  # the last bucket of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            blob = batch.column("sketch")
            offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset: blob.offset + len(blob) + 1]
            sketches = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0]: offsets[-1]].reshape(len(blob), -1)
            if packed:
                sketches = sketches.view(np.uint64)
            now = (batch.column("key").to_numpy(), batch.column("node").to_numpy(), sketches)
            if held is not None:
                now = tuple(np.concatenate(pair) for pair in zip(held, now))
            last = _runs(now[0])[-2]
            if last:
                yield within(*(x[:last] for x in now))
            held = tuple(x[last:].copy() for x in now)
        if held is not None:
            yield within(*held)
    return edges


def sketch_limit(threshold: float, size: int, packed: bool = False) -> float:
    """How many equal hashes in two sketches pairs at the threshold miss by chance only about 3 in a million times;
    of ``packed`` ones, two bits each, a quarter of the different hashes are equal too."""
    share = threshold + (1 - threshold) / 4 if packed else threshold
    return size * max(0.0, share - 4.5 * math.sqrt(share * (1 - share) / size))


def candidate_components(signatures: DataFrame, threshold: float, sketch_size: int) -> DataFrame:
    """(node, component) of the nodes that share a band with a node of a similar sketch.

    ``signatures``: node (long), bands (array<long>), sketch (binary), persisted; nodes may repeat.
    """
    entries = signatures.select("node", F.explode("bands").alias("key"))
    shared = persisted(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"),
                                                  F.count("*").alias("n")).filter("low != high")
                       .select(F.col("key").alias("k"), "n"))
    members = persisted(entries.join(shared, F.col("key") == F.col("k")).select("key", "node", "n").distinct())
    wanted = members.select(F.col("node").alias("w")).distinct()
    sketches = (signatures.select(F.col("node").alias("s"), "sketch").join(wanted, F.col("s") == F.col("w"), "left_semi")
                .groupBy("s").agg(F.min("sketch").alias("sketch")))
    return connected_components(bucket_edges(members.join(sketches, F.col("node") == F.col("s")), threshold, sketch_size))


def bucket_edges(members: DataFrame, threshold: float, sketch_size: int, packed: bool = False) -> DataFrame:
    """(a, b): spanning edges of the similar sketches among the members of each bucket.

    ``members``: key, node, n (rows of the bucket, at least its members) and sketch.  A bucket of one block is one
    group; of a larger one each pair of blocks is, so that no group grows with the bucket.
    """
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    placed = members.select("key", "node", "sketch", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.withColumn("partner", partner).withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("block", "partner"), F.greatest("block", "partner"))))
    return (pairs.select("key", "node", "sketch").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_bucket_edges(sketch_limit(threshold, sketch_size, packed), packed), "a long, b long"))


def _sets(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text in order, cut to SHINGLE_BITS: all texts sorted at once, their number in front."""
    out, ends = [], np.cumsum(counts)
    for low in range(0, len(counts), MOST_OWNERS):
        each = counts[low: low + MOST_OWNERS]
        part = shingles[ends[low] - counts[low]: ends[low + len(each) - 1]] >> _U64(64 - SHINGLE_BITS)
        part |= np.repeat(np.arange(len(each), dtype=np.uint64) << _U64(SHINGLE_BITS), each)
        part.sort()
        if len(part):
            new = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=new[1:])
            part = part[new]
        cuts = np.searchsorted(part, np.arange(1, len(each), dtype=np.uint64) << _U64(SHINGLE_BITS))
        part &= _U64((1 << SHINGLE_BITS) - 1)
        out += np.split(part, cuts)
    return out


def _intersections(sets: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted unique sets, or of those of the first ``rows`` with the others."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    if len(sets) <= MOST_OWNERS:  # plain numbers are sorted faster than their places
        both = (values << _U64(64 - SHINGLE_BITS)) | owner.astype(np.uint64)
        both.sort()
        values, owner = both >> _U64(64 - SHINGLE_BITS), (both & _U64(MOST_OWNERS - 1)).astype(np.int64)
    else:
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
    again = values[1:] == values[:-1]
    used, first = np.zeros(len(values), bool), np.ones(len(values), bool)
    used[1:], first[1:] = again, ~again
    used[:-1] |= again  # the others are in one set only
    owner, column = owner[used], np.cumsum(first[used]) - 1
    if rows is not None and len(column):  # and what all owners of one side share does not matter
        starts = _runs(column)[:-1]
        crossing = (np.minimum.reduceat(owner, starts) < rows) & (np.maximum.reduceat(owner, starts) >= rows)
        owner, column = owner[crossing[column]], (np.cumsum(crossing) - 1)[column[crossing[column]]]
    out = np.zeros((len(sets), len(sets)) if rows is None else (rows, len(sets) - rows))
    columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, columns - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part[:rows] @ part[rows or 0:].T
    return out


def _verify(shingler: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], threshold: float,
            identify: Callable | None, first: bool) -> Callable:
    """Links within sorted runs of (component, lo, hi): rows of one block (``first``) or of two.  The first time, rows of
    components of several blocks leave the task too, for the pairs of blocks."""
    def linked_rows(sets, rows=None):
        sizes = np.array([len(s) for s in sets])
        both = _intersections(sets, rows)
        linked = both >= threshold * (sizes[:rows, None] + sizes[None, rows or 0:] - both) - 1e-9
        if rows is None:
            np.fill_diagonal(linked, False)
            return linked
        whole = np.zeros((len(sets), len(sets)), bool)
        whole[:rows, rows:], whole[rows:, :rows] = linked, linked.T
        return whole

    def judge(rows, out):
        rows = list({r[0]: r for r in reversed(rows)}.values())
        if len(rows) < 2:
            return
        if not first:  # pairs within a block belong to that block's own group
            rows.sort(key=lambda r: r[2])
            if rows[0][2] == rows[-1][2]:
                return
        if len(rows) == 2:  # nearly all groups
            a, b = rows
            both = np.sort(np.concatenate([a[1], b[1]]))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= threshold * (len(both) - common) - 1e-9:
                out += [(a[0], None, b[3]), (b[0], None, a[3]), (b[0], a[0], 0)]
            return
        linked = linked_rows([r[1] for r in rows], None if first else sum(r[2] == rows[0][2] for r in rows))
        if not linked.any():
            return
        n_links = linked @ np.array([r[3] for r in rows])
        root = _forest(linked)
        for i, r in enumerate(rows):
            if n_links[i]:
                out.append((r[0], None, int(n_links[i])))
            if root[i] != i:
                out.append((r[0], rows[root[i]][0], 0))

    def emitted(out):
        links = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.binary(), pa.binary(), pa.int64()))], ["id", "other", "links"])
        if first:
            for name, kind in _WIDE.items():
                links = links.append_column(name, pa.nulls(len(out), kind))
        return links

    def wide(batch):
        some = batch.filter(pc.greater(batch.column("blocks"), 1))
        return pa.RecordBatch.from_arrays([some.column("id"), *[pa.nulls(some.num_rows, t) for t in (pa.binary(), pa.int64())],
                                           *[some.column(n).cast(t) for n, t in _WIDE.items()]], ["id", "other", "links", *_WIDE])

    def links(batches):
        key, held, out = None, [], []
        for batch in pieces(batches, "payload"):
            texts = batch.column("payload")
            hashes, counts = shingler(texts)
            keys = identify(texts) if identify else set_ids(hashes, counts)
            for own, wanted, group, block, weight, shingles in zip(
                    keys, batch.column("id").to_pylist(),
                    zip(*(batch.column(n).to_pylist() for n in ("component", "lo", "hi"))),
                    batch.column("block").to_pylist(), batch.column("weight").to_pylist(), _sets(hashes, counts)):
                if group != key:
                    if held:
                        judge(held, out)
                    key, held = group, []
                own = own.tobytes()
                if own == wanted:  # else a row that merely repeats the document's number
                    held.append((own, shingles, block, weight))
            if first and pc.max(batch.column("blocks")).as_py() > 1:
                yield wide(batch)
            if len(out) > 10_000:
                yield emitted(out)
                out = []
        if held:
            judge(held, out)
        if out:
            yield emitted(out)
    return links


#: What the first groups pass on of a row whose component has several blocks.
_WIDE = {"component": pa.int64(), "block": pa.int32(), "blocks": pa.int32(), "weight": pa.int64(), "payload": pa.string()}


def verified_links(members: DataFrame, payloads: DataFrame, join_on: str, shingler: Callable,
                   threshold: float, identify: Callable | None = None) -> DataFrame:
    """Links of at least ``threshold`` Jaccard within each component.

    An id is what ``identify`` gives for the payload, or else the id of its bag of shingles.

    ``members``: component, id (binary), ``join_on``, weight, size (characters); ``payloads``: ``join_on``
    and payload (text).  Returns (id, other, links), persisted: rows with a null ``other`` hold the summed
    weights of an id's partners in one group, the rest are edges of a spanning forest.
    """
    members = persisted(members)
    totals = persisted(members.groupBy("component").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
                       .select(F.col("component").alias("c"), "chars",
                               F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS))
                               .cast("int").alias("blocks")))
    placed = (members.join(totals, F.col("component") == F.col("c"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")))
    rows = (placed.select("component", "id", "weight", "blocks", "block", F.col(join_on).alias("j"))
            .join(payloads.select(F.col(join_on).alias("p"), "payload"), F.col("j") == F.col("p"))
            .select("component", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", "blocks", "id", "weight", "payload"))
    grouped = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    links = "id binary, other binary, links long"
    own = persisted(grouped.mapInArrow(_verify(shingler, threshold, identify, True), links + ", component long, block int, "
                                       "blocks int, weight long, payload string"))
    found, wide = own.filter("component is null").select("id", "other", "links"), own.filter("component is not null")
    chars, again = totals.agg(F.sum("chars"), F.sum(F.col("chars") * (F.col("blocks") - 1))).first()
    passes = math.ceil((again or 0) / max(chars or 0, PASS_CHARS))
    for n in range(passes):
        pairs = _pairs_of_blocks(wide, n, passes).repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
        found = found.unionByName(persisted(pairs.mapInArrow(_verify(shingler, threshold, identify, False), links)))
    return found


def _pairs_of_blocks(rows: DataFrame, n: int, passes: int) -> DataFrame:
    """``rows`` once for each pair of blocks (lo, hi) of which theirs is one and that the pass has: those whose sum leaves ``n``."""
    least = F.pmod(F.lit(n) - F.col("block"), F.lit(passes))
    partners = F.when(least < F.col("blocks"), F.sequence(least, F.col("blocks") - 1, F.lit(passes)))
    return (rows.withColumn("partner", F.explode(partners)).filter("partner != block")
            .select("component", F.least("block", "partner").alias("lo"), F.greatest("block", "partner").alias("hi"),
                    "block", "id", "weight", "payload"))
