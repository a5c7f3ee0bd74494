"""Token ids in wavelet-matrix files, as a Spark data source.

A shard file holds the ids of consecutive documents as a wavelet matrix: plane 0 has the top bit of every id, and
each further plane the next bit after the ids were stably parted by the bit before.  Planes are cut into blocks that
are compressed apart and have a directory of their offsets and of the ones before them, so one file answers, without
being unpacked whole: which id stands at a position (``access``), how often an id occurs before a position
(``rank``), where its k-th occurrence is (``select``).  Beside the planes a shard has its documents' ids and ends.

Documents are sorted by id over the whole table before they are written.  A task ends a shard once it has
``SHARD_TOKENS``, so its memory is bounded by that and the longest document.  Shards count only once the job writes
its manifest, which lists them in order; files of lost or repeated tasks are in no manifest and are never read.
"""

from __future__ import annotations

import functools
import io
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from campusflow.llm import packing
from campusflow.llm.near import pieces
from campusflow.llm.warc import _filesystem

END = 1
#: Ids after which a task ends a shard, bits of a block, and ids of a batch that the reader returns.
SHARD_TOKENS, BLOCK_BITS, BATCH_TOKENS = 1 << 22, 1 << 15, 1 << 20
#: Bytes of text tokenised at a time.
BATCH_BYTES = 8 << 20
MAGIC, MANIFEST = b"WMTOKEN1", "manifest.json"
SCHEMAS = {"documents": "doc_id long, start long, ids array<int>",
           "digests": "doc_id long, start long, n_tokens long, ids_crc32 long",
           "occurrences": "doc_id long, token int, position long",
           "counts": "token int, n long"}


# --- the file

def build(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard file: ids (uint32), and per document its id, whether it has one, and the ids up to its end."""
    packer = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    body, size, directory, zeros = [], 0, [], []
    for level in range(bits):
        plane = (ids >> np.uint32(bits - 1 - level)) & np.uint32(1) == 1
        zeros.append(int(len(ids) - np.count_nonzero(plane)))
        packed = np.packbits(plane, bitorder="little")
        step, before = BLOCK_BITS // 8, 0
        for low in range(0, len(packed), step):
            block = packed[low: low + step]
            raw = packer.compress(block.tobytes())
            directory.append((size, before))
            body.append(raw)
            size += len(raw)
            before += int(np.bitwise_count(block).sum())
        ids = np.concatenate([ids[~plane], ids[plane]])
    sections = [np.array(directory, "<u8").reshape(-1, 2).T.tobytes(), doc_ids.astype("<i8").tobytes(),
                np.packbits(known, bitorder="little").tobytes(), ends.astype("<u8").tobytes()]
    sections = [packer.compress(s) for s in sections]
    head = json.dumps({"tokens": len(ids), "documents": len(ends), "bits": bits, "zeros": zeros, "block_bits": BLOCK_BITS,
                       "sections": [len(s) for s in sections], "planes": size}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections, *body])


class Shard:
    """Random access to one shard file; only the blocks that are asked for are read."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", file.read(4))
        head = json.loads(file.read(n))
        self.tokens, self.bits, self.zeros, self.block = head["tokens"], head["bits"], head["zeros"], head["block_bits"]
        unpack = zstandard.ZstdDecompressor().decompress
        raw = [unpack(file.read(size)) for size in head["sections"]]
        self.start = len(MAGIC) + 4 + n + sum(head["sections"])
        self.blocks = -(-self.tokens // self.block)
        offsets, before = np.frombuffer(raw[0], "<u8").reshape(2, -1).astype(np.int64)
        self.offsets = np.append(offsets, head["planes"])
        self.before = before.reshape(self.bits, self.blocks)
        self.doc_ids = np.frombuffer(raw[1], "<i8")
        self.known = np.unpackbits(np.frombuffer(raw[2], np.uint8), bitorder="little")[: head["documents"]].astype(bool)
        self.ends = np.frombuffer(raw[3], "<u8").astype(np.int64)
        self._block = functools.lru_cache(maxsize=4 * self.bits)(self._read_block)

    def _read_block(self, level: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ones before each byte) of a block."""
        at = level * self.blocks + number
        self.file.seek(self.start + int(self.offsets[at]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.offsets[at + 1] - self.offsets[at])))
        block = np.frombuffer(raw, np.uint8)
        return block, np.concatenate([[0], np.cumsum(np.bitwise_count(block), dtype=np.int64)])

    def _plane(self, level: int) -> np.ndarray:
        """A whole plane as booleans, read at once."""
        first, last = level * self.blocks, (level + 1) * self.blocks
        low = int(self.offsets[first])
        self.file.seek(self.start + low)
        raw = memoryview(self.file.read(int(self.offsets[last]) - low))
        unpack = zstandard.ZstdDecompressor()
        out = b"".join(unpack.decompress(raw[int(self.offsets[i]) - low: int(self.offsets[i + 1]) - low])
                       for i in range(first, last))
        return np.unpackbits(np.frombuffer(out, np.uint8), bitorder="little")[: self.tokens].view(bool)

    def _ones(self, level: int, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ones before, bit at) each position; at the end of the plane the bit is 0."""
        ones, bit = np.empty(len(positions), np.int64), np.zeros(len(positions), bool)
        number = np.minimum(positions // self.block, max(self.blocks - 1, 0))
        for b in np.unique(number):
            rows = np.flatnonzero(number == b)
            block, counts = self._block(level, int(b))
            within = positions[rows] - b * self.block
            byte, shift = within >> 3, (within & 7).astype(np.uint8)
            held = block[np.minimum(byte, len(block) - 1)]
            held = np.where(byte < len(block), held, 0).astype(np.uint8)
            ones[rows] = self.before[level, b] + counts[byte] + np.bitwise_count(held & ((np.uint8(1) << shift) - np.uint8(1)))
            bit[rows] = (held >> shift) & 1
        return ones, bit

    def access(self, positions) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.tokens):
            raise IndexError("position outside the shard")
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits if len(at) else 0):
            ones, bit = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out * 2 + bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before ``end`` stand after the last plane."""
        low, high = 0, end
        for level in range(self.bits):
            ones, _ = self._ones(level, np.array([low, high]))
            if token >> (self.bits - 1 - level) & 1:
                low, high = (self.zeros[level] + ones).tolist()
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """How often ``token`` occurs before position ``end``, or at all."""
        if token < 0 or token >> self.bits or not self.tokens:
            return 0
        low, high = self._range(token, self.tokens if end is None else end)
        return high - low

    def select(self, token: int, numbers) -> np.ndarray:
        """The positions of the occurrences of ``token`` with the given numbers (from 0)."""
        numbers = np.asarray(numbers, np.int64)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= self.rank(token)):
            raise IndexError("no such occurrence")
        at = numbers + (self._range(token, self.tokens)[0] if len(numbers) else 0)
        for level in range(self.bits - 1, -1, -1) if len(numbers) else ():
            one = token >> (self.bits - 1 - level) & 1
            wanted = at - self.zeros[level] if one else at
            before = self.before[level] if one else np.arange(self.blocks) * self.block - self.before[level]
            number = np.searchsorted(before, wanted, "right") - 1
            at = np.empty(len(wanted), np.int64)
            for b in np.unique(number):
                rows = np.flatnonzero(number == b)
                bits = np.unpackbits(self._block(level, int(b))[0], bitorder="little")
                at[rows] = b * self.block + np.flatnonzero(bits == one)[wanted[rows] - before[b]]
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending."""
        return self.select(token, np.arange(self.rank(token)))

    def all(self) -> np.ndarray:
        """All ids (uint32): the planes are merged again from the last to the first."""
        ids = np.zeros(self.tokens, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = self._plane(level)
            merged = np.empty_like(ids)
            merged[~plane] = ids[: self.zeros[level]]
            merged[plane] = ids[self.zeros[level]:] | np.uint32(1 << (self.bits - 1 - level))
            ids = merged
        return ids


# --- the data source

class _File(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.what = options["path"], options.get("what", "documents")
        self.wanted = sorted({int(t) for t in options.get("tokens", "").split(",") if t})

    def partitions(self):
        files, root = _filesystem(self.root)
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        starts = np.concatenate([[0], np.cumsum([n for _, n in listed], dtype=np.int64)]).tolist()
        return [_File(name, start) for (name, _), start in zip(listed, starts)]

    def read(self, partition):
        if partition is None:  # no shards
            return
        files, root = _filesystem(self.root)
        with files.open_input_file(f"{root}/{partition.name}") as raw:
            shard = Shard(io.BufferedReader(raw, 1 << 20))
            yield from getattr(self, f"_{self.what}")(shard, partition.start)

    def _documents(self, shard, start, digest=False):
        ids = shard.all()
        slot = (shard.ends - np.diff(shard.ends, prepend=0)) // BATCH_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
        for low, high in zip(cuts, cuts[1:]):
            ends = shard.ends[low: high]
            first = np.concatenate([[shard.ends[low - 1] if low else 0], ends[:-1]])
            columns = [pa.array(shard.doc_ids[low: high], mask=~shard.known[low: high]), pa.array(first + start)]
            if digest:
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
                columns += [pa.array(ends - first), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
            else:
                own = pa.array(ids[first[0]: ends[-1]].astype(np.int32))
                offsets = pa.array(np.append(first, ends[-1]).astype(np.int32) - np.int32(first[0]))
                columns.append(pa.ListArray.from_arrays(offsets, own))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    def _digests(self, shard, start):
        return self._documents(shard, start, True)

    def _occurrences(self, shard, start):
        for token in self.wanted:
            total = shard.rank(token)
            for low in range(0, total, BATCH_TOKENS):
                at = shard.select(token, np.arange(low, min(low + BATCH_TOKENS, total)))
                doc = np.searchsorted(shard.ends, at, "right")
                first = shard.ends[doc] - np.diff(shard.ends, prepend=0)[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids[doc], mask=~shard.known[doc]), pa.array(np.full(len(at), token, np.int32)),
                     pa.array(at - first)], ["doc_id", "token", "position"])

    def _counts(self, shard, start):
        yield pa.RecordBatch.from_arrays([pa.array(self.wanted, pa.int32()), pa.array(
            [shard.rank(t) for t in self.wanted], pa.int64())], ["token", "n"])


class _Written(WriterCommitMessage):
    def __init__(self, task: int, files: list[tuple[str, int]]):
        self.task, self.files = task, files


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.limit = options["path"], int(options.get("shardtokens", SHARD_TOKENS))
        self.tokenizer, self.end = options.get("tokenizer"), int(options.get("end", END))

    def _ids(self, batches):
        """(document ids, token ids one after the other, how many each document has) per slice of the input."""
        if not self.tokenizer:
            for batch in batches:
                column = batch.column("ids")
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                yield batch.column("doc_id"), column.flatten().to_numpy().astype(np.uint32), sizes.astype(np.int64)
            return
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, sizes = packing.tokenize(batch.column("text"), self.tokenizer)
            yield batch.column("doc_id"), np.insert(ids, np.cumsum(sizes), self.end).astype(np.uint32), sizes + 1

    def write(self, iterator):
        files, root = _filesystem(self.root)
        files.create_dir(root, recursive=True)
        written, held, docs, tokens = [], [], [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.wm"
            ids, known, sizes = (np.concatenate(c) for c in zip(*docs))
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(build(np.concatenate(held), ids, known, np.cumsum(sizes)))
            written.append((name, tokens))

        for doc_ids, flat, sizes in self._ids(iterator):
            ends = np.cumsum(sizes)
            names = pc.fill_null(doc_ids, 0).to_numpy()
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            low = 0
            while low < len(sizes):  # whole documents until the shard has its ids
                room = self.limit - tokens + int(ends[low] - sizes[low])
                high = min(int(np.searchsorted(ends, room)) + 1, len(sizes))
                held.append(flat[ends[low] - sizes[low]: ends[high - 1]])
                docs.append((names[low: high], known[low: high], sizes[low: high]))
                tokens += len(held[-1])
                low = high
                if tokens >= self.limit:
                    flush()
                    held, docs, tokens = [], [], 0
        if docs:
            flush()
        return _Written(TaskContext.get().partitionId(), written)

    def commit(self, messages):
        files, root = _filesystem(self.root)
        files.create_dir(root, recursive=True)
        listed = [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        draft = f"{root}/{uuid.uuid4().hex}.draft"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps(listed).encode())
        files.move(draft, f"{root}/{MANIFEST}")

    def abort(self, messages):
        files, root = _filesystem(self.root)
        for name in [n for m in messages if m for n, _ in m.files]:
            files.delete_file(f"{root}/{name}")


class TokenFileSource(DataSource):
    """Options: path (folder), what (a key of SCHEMAS) and tokens (comma-joined) for reading,
    shardtokens for writing ids, and tokenizer and end as well for writing texts."""

    @classmethod
    def name(cls):
        return "token_file"

    def schema(self):
        return SCHEMAS[self.options.get("what", "documents")]

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


# --- the operators

def ordered_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, in ascending order of id over all partitions.

    Rows that repeat an id come in the order of a hash of their text; rows without an id come last.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # repeated rows may be many: the row number lets them fall into several ranges
    place = [F.col("doc_id").asc_nulls_last(), "hash", "row"]
    d = d.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    return d.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")


def _write(rows: DataFrame, path: str, **options) -> None:
    files, root = _filesystem(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} already holds token files")
    rows.sparkSession.dataSource.register(TokenFileSource)
    rows.write.format("token_file").mode("append").options(**options).save(path)


def write_texts(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write every row's ids, with ``end`` after the last, to the folder ``path`` in the order of ``ordered_texts``.

    The folder must have no manifest yet.  The tasks that write tokenise, so ids are not moved between processes.
    Null and empty texts have the end id only; repeated rows are documents each; other columns are ignored; an empty
    table gives an empty manifest.  ``tokenizer_path`` must exist on every executor.
    """
    _write(ordered_texts(docs, id_col, text_col), path, tokenizer=tokenizer_path, end=end, shardtokens=shard_tokens)


def write_tokens(tokens: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write ``tokens`` (doc_id, ids array<int>; null counts as none) as they are, in the order of their partitions."""
    _write(tokens.select("doc_id", "ids"), path, shardtokens=shard_tokens)


def _read(spark: SparkSession, path: str, what: str, **options) -> DataFrame:
    spark.dataSource.register(TokenFileSource)
    return spark.read.format("token_file").options(what=what, **options).load(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids of every document."""
    return _read(spark, path, "documents")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of its ids (little-endian, 32 bits each) of every document."""
    return _read(spark, path, "digests")


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """doc_id, token and position (in its document) of every occurrence, found by select on the planes."""
    return _read(spark, path, "occurrences", tokens=",".join(map(str, tokens)))


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n: how often each occurs in all documents, found by rank on the planes."""
    return _read(spark, path, "counts", tokens=",".join(map(str, tokens))).groupBy("token").agg(F.sum("n").alias("n"))


def delete_files(path: str) -> None:
    files, root = _filesystem(path)
    files.delete_dir(root)
