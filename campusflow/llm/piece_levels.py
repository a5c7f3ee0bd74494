"""The trie walk of byte-pair pieces, a level of the trie at a time.

All distinct words of a batch advance by one character together.  Nodes of a level, the distinct prefixes of its length,
share their forward state as in ``pieces``: the last piece and where it starts.  An automaton over the pieces
(Aho-Corasick) names the longest piece that ends at a node; shorter ones follow by its failure links.
"""

from __future__ import annotations

import numpy as np

#: Verdicts on neighbours that a worker remembers.
REMEMBERED = 1 << 20
_CHARS = 1 << 21


class _Lookup:
    """Values of sorted distinct keys; -1 for others."""

    def __init__(self, found: dict[int, int]):
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)


def _suffixes(usable: dict[str, int]) -> tuple[_Lookup, np.ndarray, np.ndarray, np.ndarray]:
    """(children by state and character, failure links, the longest piece of each state, the next shorter of each piece)."""
    child, char, depth_of, parent, end = {}, [0], [0], [0], {}
    for text, piece in usable.items():
        state = 0
        for c in map(ord, text):
            after = child.get(state * _CHARS + c)
            if after is None:
                after = child[state * _CHARS + c] = len(char)
                char.append(c)
                parent.append(state)
                depth_of.append(depth_of[state] + 1)
            state = after
        end[state] = piece
    fail, longest, shorter = [0] * len(char), [-1] * len(char), [-1] * (max(usable.values(), default=-1) + 1)
    for state in sorted(range(1, len(char)), key=depth_of.__getitem__):
        if depth_of[state] > 1:
            back = fail[parent[state]]
            while back and back * _CHARS + char[state] not in child:
                back = fail[back]
            fail[state] = child.get(back * _CHARS + char[state], 0)
        longest[state] = longest[fail[state]]
        if state in end:
            shorter[end[state]], longest[state] = longest[state], end[state]
    return _Lookup(child), np.array(fail), np.array(longest), np.array(shorter, np.int64)


class Levels:
    """Walks many words at once; ``vocabulary`` is a ``pieces.Vocabulary`` of kind bpe."""

    def __init__(self, vocabulary):
        v, self.base = vocabulary, len(vocabulary.piece)
        self.child, self.fail, self.longest, self.shorter = _suffixes(v.usable)
        self.score, self.length = np.array(v.score, float), np.array([len(p) for p in v.piece])
        self.made = np.where(self.length > 1, self.score, np.inf)  # the score of a piece's last merge
        self.parts = np.full((self.base, 2), -1, np.int64)
        for piece in v.usable.values():
            self.parts[piece] = v.parts(piece)
        across = {}
        for text, piece in v.id_of.items():
            for k in range(1, len(text)):
                left, right = v.id_of.get(text[:k]), v.id_of.get(text[k:])
                if left is not None and right is not None:
                    across[left * self.base + right] = piece
        self.across = _Lookup(across)
        self.known = np.full(REMEMBERED, -1, np.int64)  # a pair at its place, and its verdict
        self.verdict = np.zeros(REMEMBERED, bool)
        self.unknown_id, self.byte_id = v.unknown_id, None
        if v.byte_id:
            self.byte_id = np.array([v.byte_id.get(b, v.unknown_id) for b in range(256)])

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows`` of many pairs of pieces."""
        pairs = left * self.base + right
        place = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % REMEMBERED
        missing = self.known[place] != pairs
        out = self.verdict[place]
        if missing.any():
            fresh, back = np.unique(pairs[missing], return_inverse=True)
            judged = self._not_crossed(fresh // self.base, fresh % self.base)
            out[missing] = judged[back]
            self.known[place[missing]], self.verdict[place[missing]] = pairs[missing], out[missing]
        return out

    def _not_crossed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # see Vocabulary._not_crossed
        out, at = np.ones(len(left), bool), np.arange(len(left))
        left_used = right_used = np.full(len(left), -np.inf)
        while len(at):
            across = self.across(left * self.base + right)
            score = np.where(across < 0, -np.inf, self.score[across])
            crossed = (across >= 0) & (score > left_used) & (score >= right_used)
            out[at[crossed]] = False
            left_made, right_made = self.made[left], self.made[right]
            undo = (right_made <= left_made) & (right_made < np.inf)
            left_used, right_used = np.where(undo, left_used, left_made), np.where(undo, right_made, right_used)
            going = ~crossed & ((left_made < np.inf) | undo)
            left, right = np.where(undo, left, self.parts[left, 1]), np.where(undo, self.parts[right, 0], right)
            going &= (left >= 0) & (right >= 0)
            at, left, right, left_used, right_used = (x[going] for x in (at, left, right, left_used, right_used))
        return out

    def encode_sorted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, how many each has) of sorted distinct words that are not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes + np.arange(len(words))  # a place for each prefix, the empty one too
        node_at = np.zeros(int(sizes.sum()) + len(words), np.int64)
        n = 1  # nodes so far, the root first
        pieces = np.full(len(node_at) + 1, -1, np.int64)  # by node: there are no more than places
        starts = np.zeros(len(node_at) + 1, np.int64)
        active, state, node = np.arange(len(words)), np.zeros(1, np.int64), np.zeros(len(words), np.int64)
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            going = sizes[active] >= depth
            if not going.all():
                active, node = active[going], node[going]
            char = chars[first[active] - active + depth - 1]
            new = np.ones(len(active), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            lead, before = active[new], n - len(state)
            state = self._advance(state[node[new] - before], char[new])
            node = np.cumsum(new) + (n - 1)
            node_at[first[active] + depth] = node
            self._step(state, depth, n, first[lead], node_at, pieces, starts)
            n += len(state)
        return self._paths(words, sizes, first, node_at, pieces, starts, chars)

    def _advance(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The automaton's states after one more character."""
        out, at = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(at):
            after = self.child(state * _CHARS + char)
            found = after >= 0
            out[at[found]] = after[found]
            going = ~found & (state > 0)
            at, state, char = at[going], self.fail[state[going]], char[going]
        return out

    def _step(self, state, depth, n, first, node_at, pieces, starts) -> None:
        """The last piece and its start of a level's nodes, numbered from ``n``: the longest piece that fits."""
        starts[n: n + len(state)] = depth - 1
        piece, at = self.longest[state], np.arange(len(state))
        while True:
            some = piece >= 0
            at, piece = at[some], piece[some]
            if not len(at):
                return
            start = depth - self.length[piece]
            left = pieces[node_at[first[at] + start]]
            fits = left < 0  # the word's begin, or a character that merges with nothing
            inner = np.flatnonzero(~fits)
            fits[inner] = self.follows(left[inner], piece[inner])
            pieces[n + at[fits]], starts[n + at[fits]] = piece[fits], start[fits]
            at, piece = at[~fits], self.shorter[piece[~fits]]

    def _paths(self, words, sizes, first, node_at, pieces, starts, chars) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words' paths, which go from their ends to their begins."""
        word, end, held = np.arange(len(words)), sizes, []
        while len(word):
            node = node_at[first[word] + end]
            held.append((word, pieces[node], starts[node]))
            end = starts[node]
            word, end = word[end > 0], end[end > 0]
        if not held:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, piece, start = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(first[word] + start)
        word, piece, start = word[order], piece[order], start[order]
        lone = np.flatnonzero(piece < 0)
        piece[lone] = self.unknown_id
        if len(lone) and self.byte_id is not None:  # unknown characters become their bytes
            code = chars[first[word[lone]] - word[lone] + start[lone]]
            each = np.ones(len(piece), np.int64)
            each[lone] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            raw = np.frombuffer(code.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
            as_bytes = np.zeros(len(piece), bool)
            as_bytes[lone] = True
            word, piece, as_bytes = np.repeat(word, each), np.repeat(piece, each), np.repeat(as_bytes, each)
            piece[as_bytes] = self.byte_id[raw]
        return piece.astype(np.int32), np.bincount(word, minlength=len(words))
