"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

Each task tokenises its documents and packs them window by window, so nothing is shuffled and a repeated task
gives the same sequences.  In a window the cost of a document is estimated as linear plus quadratic (attention)
in its tokens; documents in descending order go to the sequence of lowest cost that still has room for them,
and what fits nowhere whole is cut at the room that is left.  What fills no sequence moves to the next window;
the last tokens of a task make sequences of lengths that are powers of two, which need no padding.

Tokens: the words of a text (runs without ASCII white space) are tokenised apart, each distinct one once per
batch; no token of this vocabulary spans white space.  Words of Latin-1 characters take a fast byte-pair
encoder over the same merges, all others the tokenizers library itself.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from campusflow.llm.near import pieces

CAPACITY, END = 4096, 2
#: Sequences in a window, the cost of a token, and of a pair of tokens.
WINDOW, LINEAR, QUADRATIC = 256, 1.0, 1.0 / 1024
#: Bytes of text tokenised at a time.
BATCH_BYTES = 8 << 20
#: How the tokenizer splits lower-case text; must equal the tokenizer file's pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks after a split and after a word: capitals, which lower-case text has none of.
SPLIT_END, WORD_END = "W", "X"
SEQUENCE_BITS = 33


def _byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the rest moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(moved)}}


@functools.lru_cache(maxsize=2)
def _encoders(path: str) -> tuple[Tokenizer, tiktoken.Encoding, int]:
    """The tokenizer, the fast encoder with the same ids, and the id that ends a word there."""
    slow = Tokenizer.from_file(path)
    symbols, ranks, suffix = _byte_symbols(), {}, "</w>"
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    for token, i in slow.get_vocab(with_added_tokens=False).items():
        if token not in special:
            ends = len(token) > len(suffix) and token.endswith(suffix)
            core = token.removesuffix(suffix) if ends else token
            ranks[bytes(symbols[c] for c in core) + SPLIT_END.encode() * ends] = i
    fast = tiktoken.Encoding("words", pat_str=f"{WORD_END}|[^{WORD_END}{SPLIT_END}]+{SPLIT_END}", mergeable_ranks=ranks,
                             special_tokens={})
    return slow, fast, ranks[WORD_END.encode()]


def _word_tokens(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words one after the other, how many each has)."""
    slow, fast, end = _encoders(path)
    simple = pc.and_(pc.match_substring_regex(words, r"^[\x21-\x7E\x{A1}-\x{FF}]+$"),
                     pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(words), np.int64)
    parts: list[np.ndarray] = []
    easy = words.filter(pa.array(simple)).to_pylist()
    if easy:
        marked = regex.sub(SPLIT, r"\g<0>" + SPLIT_END, " ".join(easy).lower()).replace(" ", WORD_END) + WORD_END
        ids = fast.encode_to_numpy(marked)
        ends = np.flatnonzero(ids == end)
        counts[simple] = np.diff(ends, prepend=-1) - 1
        parts.append(ids[ids != end])
    hard = words.filter(pa.array(~simple)).to_pylist()
    encoded = [e.ids for e in slow.encode_batch(hard, add_special_tokens=False)] if hard else []
    counts[~simple] = [len(e) for e in encoded]
    parts.extend(np.array(e, np.uint32) for e in encoded)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    # flat has the easy words first: bring the counts' order and the ids' order together
    order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
    starts = np.empty(len(words), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return _gather(flat, starts, counts), counts


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start: start + count]`` one after the other."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def tokenize(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts one after the other, how many each has), without special tokens; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    flat, counts = _word_tokens(words.dictionary, path)
    index = words.indices.to_numpy()
    per_word = counts[index]
    total = np.concatenate([[0], np.cumsum(per_word)])
    return _gather(flat, (np.cumsum(counts) - counts)[index], per_word), np.diff(total[offsets - offsets[0]])


def cost(tokens):
    """The estimated cost of a document's tokens in one sequence."""
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def balance(lengths: list[int], n_sequences: int, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): documents in descending order, each to the sequence of lowest
    cost with room for it, cut where none has; together the sequences get full if there are tokens enough."""
    out = []
    left = np.full(n_sequences, capacity)
    costs = np.zeros(n_sequences)
    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start = 0
        while start < lengths[d] and left.any():
            need = min(lengths[d] - start, capacity)
            fits = left >= need
            s = int(np.where(fits if fits.any() else left > 0, costs, np.inf).argmin())
            take = min(need, int(left[s]))
            out.append((d, start, take, s, capacity - int(left[s])))
            left[s] -= take
            costs[s] += cost(take)
            start += take
    return out


def power_lengths(tokens: int) -> list[int]:
    """Powers of two that sum to ``tokens``, largest first."""
    return [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1]


def _packer(path: str, capacity: int, window: int):
    def pack(batches):
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        pending: list[tuple] = []  # (doc_id, start of the piece, ids, doc_tokens)
        held = 0

        def rows(placed):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*placed)], names)

        def row(p, start, length, s, offset):
            doc, before, ids, total = p
            return doc, before + start, length, zlib.crc32(ids[start: start + length].tobytes()), total, s, offset

        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, counts = tokenize(batch.column("text"), path)
            ends = np.cumsum(counts)
            for doc, low, high in zip(batch.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
                own = np.append(ids[low:high], END).astype("<u4")
                pending.append((doc, 0, own, len(own)))
                held += len(own)
                while held >= window * capacity:
                    # one document may fill several windows: no window takes more sequences than it has
                    placed = balance([len(p[2]) for p in pending], window, capacity)
                    yield rows([row(pending[d], a, n, sequence + s, o) for d, a, n, s, o in placed])
                    used = np.zeros(len(pending), np.int64)
                    for d, _, n, _, _ in placed:
                        used[d] += n
                    pending = [(p[0], p[1] + int(u), p[2][u:], p[3]) for p, u in zip(pending, used) if u < len(p[2])]
                    held -= window * capacity
                    sequence += window
        if held:
            full = held // capacity
            placed = balance([len(p[2]) for p in pending], full, capacity) if full else []
            out = [row(pending[d], a, n, sequence + s, o) for d, a, n, s, o in placed]
            used = np.zeros(len(pending), np.int64)
            for d, _, n, _, _ in placed:
                used[d] += n
            sequence += full
            lengths = power_lengths(held - full * capacity)
            offset = 0
            for p, u in zip(pending, used.tolist()):
                while u < len(p[2]):
                    take = min(len(p[2]) - u, lengths[0] - offset)
                    out.append(row(p, u, take, sequence, offset))
                    u, offset = u + take, offset + take
                    if offset == lengths[0]:
                        lengths, offset, sequence = lengths[1:], 0, sequence + 1
            yield rows(out)
    return pack


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is a document of its own, whatever its id (null and repeated ones included); its ids are the
    tokenizer's and then END, so null and empty texts are one token.  Long documents are cut at sequence ends.
    Which pieces share a sequence depends on how the input is cut into tasks, and each task ends with sequences of
    up to twelve powers of two; the ids of a document do not.
    Other columns are ignored; an empty table gives no rows.  ``tokenizer_path`` must exist on every executor.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_packer(tokenizer_path, capacity, window),
                        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                        "offset long")
