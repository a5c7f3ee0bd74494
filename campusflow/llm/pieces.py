"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked as the library does (a mark for every space and one in front) and cut into marked words where
a mark follows another character; no piece spans such a place.  A task sorts the distinct words of a batch,
which lays them out as the depth-first order of their trie, and keeps one forward state per character of the
current path: a word starts from the states of the prefix that it shares with the word before.  For byte-pair models
short words walk that trie level by level instead, all nodes of a level at once (see ``piece_levels``).

Forward states.  ``unigram`` models: the best sum of scores that ends there, as in Viterbi.  ``bpe`` models: a
sum of scores would not give the library's pieces, so a path's weight is whether byte-pair merging yields it.
A run of pieces is what merging yields exactly if that holds for each two neighbours, so one path survives at
each character, and it depends on nothing but the last piece before it.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from campusflow.llm import near
from campusflow.llm.piece_levels import Levels

MARK = "▁"
#: Bytes of text encoded at a time, and neighbour verdicts that a worker remembers.
BATCH_BYTES, REMEMBERED = 4 << 20, 1_000_000
#: Distinct words whose ids are kept from batch to batch.
MEMO_WORDS = 500_000
#: Characters of a byte-pair model's words that are walked by levels; few words are longer.
LEVELS = 64
#: What an unknown character scores below the lowest piece in a unigram model.
UNKNOWN_PENALTY = 10.0
_UNKNOWN = -1


class Vocabulary:
    """Pieces of a model file with the forward step of its kind."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str = "bpe"):
        """``pieces``: (piece, score, type) by id; type is normal, byte, control or unknown."""
        self.kind = kind
        self.id_of = {p: i for i, (p, _, t) in enumerate(pieces) if t == "normal"}
        self.score = [s for _, s, _ in pieces]
        self.piece = [p for p, _, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == "byte"}
        self.unknown_id = next((i for i, (_, _, t) in enumerate(pieces) if t == "unknown"), 0)
        self.lowest = min((self.score[i] for i in self.id_of.values()), default=0.0)
        self.raw = [b"" if t in ("control", "unknown") else bytes([int(p[3:5], 16)]) if t == "byte"
                    else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}
        self._forget()
        self.levels: Levels | None = None
        # pieces that a path can hold, and by the last (up to three) characters the lengths of those that end so
        self.usable = {p: i for p, i in self.id_of.items() if kind == "unigram" or self.parts(i) is not None}
        by_tail: dict[str, set[int]] = {}
        for p in self.usable:
            by_tail.setdefault(p[-3:], set()).add(len(p))
        self.tails = {t: sorted(n.union(*[by_tail.get(t[k:], ()) for k in range(1, len(t))]), reverse=True)
                      for t, n in by_tail.items()}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging yields, highest score first and of equals the leftmost, and the last pair merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.id_of.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces last merged into this one; (piece, piece) for one character; None if merging a piece's
        characters does not yield it."""
        if piece not in self._parts:
            text = self.piece[piece]
            if len(text) == 1:
                self._parts[piece] = (piece, piece)
            else:
                whole, last = self.merged(text)
                ids = tuple(self.id_of.get(x) for x in last) if len(whole) == 1 else (None, None)
                # a part without an id is a character that only occurs inside longer pieces
                self._parts[piece] = tuple(_UNKNOWN if x is None else x for x in ids) if len(whole) == 1 else None
        return self._parts[piece]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters yields just these two."""
        if left == _UNKNOWN or right == _UNKNOWN:
            return True
        key = left * len(self.piece) + right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > REMEMBERED:
                self._follows.clear()
            known = self._follows[key] = self._not_crossed(left, right)
        return known

    def _not_crossed(self, left: int, right: int) -> bool:
        # Go back in time from the two finished pieces.  At each moment one piece touches the border from either
        # side; each is used up by the merge that made the piece after it.  A merge across the border happens if
        # it beats both of those merges (at equal score the one further left comes first).
        left_used = right_used = float("-inf")
        while True:
            across = self.id_of.get(self.piece[left] + self.piece[right])
            if across is not None and self.score[across] > left_used and self.score[across] >= right_used:
                return False
            left_made = self.score[left] if len(self.piece[left]) > 1 else None
            right_made = self.score[right] if len(self.piece[right]) > 1 else None
            if left_made is None and right_made is None:
                return True
            # undo the later of the two merges; of equals the right one came later
            if right_made is not None and (left_made is None or right_made <= left_made):
                right_used, right = right_made, self.parts(right)[0]
            else:
                left_used, left = left_made, self.parts(left)[1]
            if _UNKNOWN in (left, right):
                return True

    def step(self, word: str, end: int, states: list) -> tuple:
        """The state (piece, start, score) of the best path to ``end``, from the states of all shorter prefixes."""
        best = None
        tails, tail = self.tails, word[end - 3 if end > 3 else 0: end]
        for length in tails.get(tail) or tails.get(tail[-2:]) or tails.get(tail[-1:], ()):
            if length > end:
                continue
            start = end - length
            piece = self.usable.get(word[start:end])
            if piece is None:
                continue
            score = states[start][2] + self.score[piece]
            if best is None or score > best[2]:
                best = (piece, start, score)
        if best is None or word[end - 1] not in self.id_of:
            lone = (_UNKNOWN, end - 1, states[end - 1][2] + self.lowest - UNKNOWN_PENALTY)
            if best is None or lone[2] > best[2]:
                return lone
        return best

    def ids(self, word: str, states: list) -> list[int]:
        """The ids of a word's path; unknown characters become their bytes, or the unknown piece."""
        out: list[int] = []
        end = len(word)
        while end:
            piece, start, _ = states[end]
            if piece != _UNKNOWN:
                out.append(piece)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(word[start:end].encode()))
            else:
                out.append(self.unknown_id)
            end = start
        return out[::-1]

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """The ids of sorted distinct words: a depth-first walk of their trie."""
        if self.kind == "bpe":
            return self._merged_sorted(words)
        out, states, before = [], [(_UNKNOWN, 0, 0.0)], ""
        for word in words:
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.step(word, end, states))
            out.append(self.ids(word, states))
            before = word
        return out

    def _merged_sorted(self, words: list[str]) -> list[list[int]]:
        """The same walk for byte-pair models, where a state is the last piece and its start."""
        usable, tails, known, follows, base = self.usable, self.tails, self._follows, self.follows, len(self.piece)
        as_bytes, unknown = self.byte_id, self.unknown_id
        last, begin, before, out = [_UNKNOWN], [0], "", []
        for word in words:
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], begin[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 if end > 3 else 0: end]
                for length in tails.get(tail) or tails.get(tail[-2:]) or tails.get(tail[-1:], ()):
                    if length <= end:
                        start = end - length
                        piece = usable.get(word[start:end])
                        if piece is not None:
                            left = last[start]
                            if left < 0:  # the word's begin, or a character that merges with nothing
                                break
                            fits = known.get(left * base + piece)
                            if fits if fits is not None else follows(left, piece):
                                break
                else:
                    piece, start = _UNKNOWN, end - 1
                last.append(piece)
                begin.append(start)
            ids, end = [], len(word)
            while end:
                piece, start = last[end], begin[end]
                if piece >= 0:
                    ids.append(piece)
                elif as_bytes:
                    ids.extend([as_bytes[b] for b in reversed(word[start:end].encode())])
                else:
                    ids.append(unknown)
                end = start
            out.append(ids[::-1])
            before = word
        return out

    def encode_marks(self, n: int) -> list[int]:
        """A run of marks by itself: all merges of it are of equal score, so the leftmost comes first."""
        run: list[int] = []
        for _ in range(n):
            run.append(1)
            while len(run) > 1 and MARK * (run[-2] + run[-1]) in self.id_of:
                run[-2:] = [run[-2] + run[-1]]
        return [self.id_of[MARK * size] for size in run]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct marked words in any order."""
        flat, starts, counts = self.encode_flat(words)
        return [flat[a: a + n].tolist() for a, n in zip(starts.tolist(), counts.tolist())]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has) of distinct marked words in any order."""
        if self.kind == "unigram":
            order = sorted(range(len(words)), key=words.__getitem__)
            found = self.encode_sorted([words[i] for i in order])
            flat, counts = _flat([f for _, f in sorted(zip(order, found))])
            return flat, np.cumsum(counts) - counts, counts
        # runs of marks merge after everything else: the word with its last mark comes first
        runs = [i for i, w in enumerate(words) if w[1:2] == MARK or w == MARK]
        cores = words.copy()
        for i in runs:
            cores[i] = MARK + words[i].lstrip(MARK)
        distinct = set(cores)
        distinct.discard(MARK)
        if len(self.memo) + len(distinct) > MEMO_WORDS:
            self._forget()
        fresh = sorted(distinct.difference(self.memo))  # what a batch before has met is not walked again
        self._remember(fresh)
        place = np.fromiter(map(self.memo.get, cores, itertools.repeat(0)), np.int64, len(cores))
        flat, starts, counts = self.memo_ids, self.memo_starts[place], self.memo_counts[place]
        mark, marked = self.id_of.get(MARK), []
        for i in runs:
            ids = [mark] if cores[i] == MARK else flat[starts[i]: starts[i] + counts[i]].tolist()
            more = len(words[i]) - len(cores[i])
            marked.append(self.encode_marks(more + 1) + ids[1:] if ids[0] == mark else self.encode_marks(more) + ids)
        if runs:
            more, each = _flat(marked)
            starts[runs], counts[runs] = len(flat) + np.cumsum(each) - each, each
            flat = np.concatenate([flat, more])
        return flat, starts, counts

    def _forget(self) -> None:
        self.memo, self.memo_ids = {}, np.zeros(0, np.int32)
        self.memo_starts = self.memo_counts = np.zeros(0, np.int64)

    def _remember(self, fresh: list[str]) -> None:
        """Encodes sorted words: depth-first or, where they are short, by levels."""
        if self.levels is None:
            self.levels = Levels(self)
        short, long = [w for w in fresh if len(w) <= LEVELS], [w for w in fresh if len(w) > LEVELS]
        found = [self.levels.encode_sorted(short), _flat(self.encode_sorted(long))]
        self.memo.update(zip(short + long, range(len(self.memo), len(self.memo) + len(fresh))))
        self.memo_ids = np.concatenate([self.memo_ids, *[ids for ids, _ in found]])
        self.memo_counts = np.concatenate([self.memo_counts, *[counts for _, counts in found]])
        self.memo_starts = np.cumsum(self.memo_counts) - self.memo_counts


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of the lists one after the other, how many each has)."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(counts.sum())), counts


@functools.lru_cache(maxsize=2)
def load(path: str, kind: str = "bpe") -> Vocabulary:
    model = SentencePieceProcessor(model_file=path)

    def type_of(i):
        return ("byte" if model.is_byte(i) else "control" if model.is_control(i) else
                "unknown" if model.is_unknown(i) else "unused" if model.is_unused(i) else "normal")
    return Vocabulary([(model.id_to_piece(i), model.get_score(i), type_of(i)) for i in range(model.get_piece_size())],
                      kind)


_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode_texts(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts one after the other, how many each has); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # single spaces only: the words are what lies between spaces, each with one mark
    plain = np.ones(len(texts), bool)
    for odd in ("  ", MARK):
        plain &= ~pc.match_substring(texts, odd).to_numpy(zero_copy_only=False)
    for test in (pc.starts_with, pc.ends_with):
        plain &= ~test(texts, " ").to_numpy(zero_copy_only=False)
    plain &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    words = lists.values.dictionary_encode()
    index = {MARK + w: i for i, w in enumerate(words.dictionary.to_pylist())}
    spots, sizes = [words.indices.to_numpy().astype(np.int64)], np.zeros(len(texts), np.int64)
    sizes[plain] = np.diff(lists.offsets.to_numpy())
    others: list[int] = []
    for row in np.flatnonzero(~plain).tolist():
        text = texts[row].as_py()
        found = _WORDS.findall((MARK + text).replace(" ", MARK)) if text else []
        others.extend([index.setdefault(w, len(index)) for w in found])
        sizes[row] = len(found)
    spots = np.concatenate([*spots, np.array(others, np.int64)])
    flat, begins, counts = vocabulary.encode_flat(list(index))
    # spots has the plain texts first: bring the texts' words into the order of the texts
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    first = np.empty(len(texts), np.int64)
    first[order] = np.cumsum(sizes[order]) - sizes[order]
    ends = np.cumsum(sizes)
    at = spots[np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())]
    per_word = counts[at]
    total = np.concatenate([[0], np.cumsum(per_word)])
    out = flat[np.repeat(begins[at] - total[:-1], per_word) + np.arange(total[-1])]
    return out, np.diff(total[np.concatenate([[0], ends])])


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The texts of runs of ids: pieces joined, bytes read as UTF-8, marks as spaces, the one in front dropped."""
    raw = pa.array(vocabulary.raw, pa.binary()).take(pa.array(ids))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), raw), b"")
    return [t.decode("utf-8", "replace").removeprefix(" ") for t in joined.to_pylist()]


def _encoder(path: str, kind: str):
    def encode(batches):
        vocabulary = load(path, kind)
        for batch in near.pieces(batches, "text", BATCH_BYTES):
            ids, counts = encode_texts(batch.column("text"), vocabulary)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), batch.column("text")],
                ["doc_id", "ids", "text"])
    return encode


def _round_tripper(path: str):
    def both(batches):
        vocabulary = load(path)
        for batch in near.pieces(batches, "text", BATCH_BYTES):
            ids, counts = encode_texts(batch.column("text"), vocabulary)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            same = [a == b for a, b in zip(decode_ids(ids, counts, vocabulary), texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                 pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])
    return both


def _decoder(path: str):
    def decode(batches):
        vocabulary = load(path)
        for batch in batches:
            ids = batch.column("ids")
            known = pc.list_value_length(ids)
            counts = pc.fill_null(known, 0).to_numpy(zero_copy_only=False)
            texts = decode_ids(ids.flatten().to_numpy(), counts, vocabulary)
            gone = ids.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in batch.schema.names],
                 pa.array([None if g else t for g, t in zip(gone, texts)], pa.string())],
                [*batch.schema.names, "decoded"])
    return decode


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           kind: str = "bpe") -> DataFrame:
    """doc_id, ids and text per input row.

    Null and empty texts have no ids; repeated rows and null ids are rows like others; other columns are
    ignored; an empty table gives no rows.  ``model_path`` must exist on every executor.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_encoder(model_path, kind), "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and decoded text per input row; null ids give null, no ids the empty text."""
    d = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return d.mapInArrow(_decoder(model_path), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids and whether decoding gives the text back (null counts as empty), in one pass."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_round_tripper(model_path), "doc_id long, n_ids long, ids array<int>, round_trip boolean")
