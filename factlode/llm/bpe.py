"""Byte-level BPE over whole Arrow batches, and exact concatenation of encoded texts.

The encoder works on a batch at a time: one pass of array operations finds the pieces between which no merge is
possible, equal pieces are merged once and their ids copied to every place where they stand.  ``Encoded.join`` builds the encoding
of ``a + b`` from those of ``a`` and ``b`` by encoding anew only a window around the seam, widened until both sides agree.
"""

from __future__ import annotations

import base64
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 4

#: Unicode white space, as \s has it in the tokenizer's pattern.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Fixed value: the public tokenizer's split pattern, for the plain path.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A boundary that lies at least this many characters before the end of a text stands whatever follows.
LOOKAHEAD = 3


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get((c := unicodedata.category(chr(i)))[0], UNKNOWN if c == "Cn" else OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


@lru_cache(1)
def _noise() -> np.ndarray:
    return np.random.default_rng(20260731).integers(1, 2**63, 0x110000, dtype=np.uint64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def piece_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Marks the first character of every piece in texts that lie one behind the other in ``cp``.

    text_starts: where each text that is not empty begins.
    """
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    inner = ~first[1:]  # the next character belongs to the same text
    nxt = np.append(kind[1:], SPACE)
    last_white = np.flatnonzero((kind == SPACE) & (nxt != SPACE) & inner)
    start[last_white] = True
    start[last_white[cp[last_white] == 32] + 1] = False
    quote = np.flatnonzero((cp == 39) & start & inner & (nxt == LETTER))
    if len(quote):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], np.where(first[np.minimum(quote + 2, n)], 0, pad[quote + 2])
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        at, size = quote[one | two], np.where(one, 2, 3)[one | two]
        start[at + 1] = False
        after = at + size
        start[after[after < n]] = True
    return start


@dataclass
class Encoded:
    """A text with its pieces: first characters, first ids, and the ids."""

    text: str
    starts: np.ndarray
    firsts: np.ndarray  # one more than pieces: where the ids of each begin
    ids: np.ndarray

    def join(self, right: "Encoded", bpe: "Bpe") -> "Encoded":
        """The encoding of both texts as one."""
        if not self.text or not right.text:
            return right if right.text else self
        n = len(self.text)
        k = max(0, int(np.searchsorted(self.starts, n - LOOKAHEAD, "right")) - 1)
        from_left, width = int(self.starts[k]), 64
        head = n - from_left
        while True:
            whole = width >= len(right.text)
            window = self.text[from_left:] + right.text[:width]
            cp = codes(window)
            cuts = np.flatnonzero(piece_starts(cp, np.zeros(1, np.int64)))
            safe = cuts[(cuts >= head) & (cuts <= len(cp) - LOOKAHEAD)] - head
            both = safe[np.isin(safe, right.starts)] if len(safe) else safe
            if len(both) or whole:
                break
            width *= 4
        to = int(both[0]) if len(both) else len(right.text)
        j = int(np.searchsorted(right.starts, to))
        cuts = cuts[cuts < head + to]
        ends = np.append(cuts[1:], head + to)
        middle = []
        for a, b in zip(cuts.tolist(), ends.tolist()):
            across = a < head < b
            if across and k + 1 == len(self.starts) and a == 0 and j == 1 and b - a > 64:
                middle.append(bpe.seam(self.ids[self.firsts[k] :], right.ids[: right.firsts[1]]))
            else:
                middle.append(bpe.piece(window[a:b]))
        sizes = [len(x) for x in middle]
        base = int(self.firsts[k])
        firsts = np.concatenate([self.firsts[:k], base + np.cumsum([0, *sizes])[:-1], right.firsts[j:] - right.firsts[j] + base + sum(sizes)])
        return Encoded(
            self.text + right.text,
            np.concatenate([self.starts[:k], cuts + from_left, right.starts[j:] + n]),
            firsts,
            np.concatenate([self.ids[:base], *middle, right.ids[right.firsts[j] :]]),
        )


class Bpe:
    """The merges of one rank file (tiktoken's format)."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.others: dict[str, int] = {}
        self.words: list[str] = []
        self.chunks: list[np.ndarray] = []
        self.at, self.size, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.int32)

    def piece(self, text: str) -> np.ndarray:
        return np.array(self.plain._encode_single_piece(text), np.int32)

    def seam(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one piece whose parts have the ids ``left`` and ``right``.

        Ids are the piece's own exactly if every two neighbours are; a window that begins with an id of
        the left and ends with one of the right therefore fixes all the rest.
        """
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            window = np.array(self.plain._encode_single_piece(b"".join(self.bytes_of[int(x)] for x in (*a, *b))), np.int32)
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], window, right[len(b) :]])
            k *= 2

    def _learn(self, h: int | None, word: str) -> int:
        ids = self.piece(word)
        k, need = len(self.words), self.used + len(ids)
        if k == len(self.at):
            self.at, self.size = np.append(self.at, np.zeros(k, np.int64)), np.append(self.size, np.zeros(k, np.int64))
        while need > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(len(self.flat), np.int32))
        self.flat[self.used : need] = ids
        self.at[k], self.size[k], self.used = self.used, len(ids), need
        self.words.append(word)
        if h is not None:
            self.known[h] = k
        return k

    def _entries(self, blob: str, lengths: np.ndarray):
        """Of texts one behind the other: the known word at each piece, the pieces' starts, and the pieces of each text."""
        cp = codes(blob)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        start = piece_starts(cp, offsets[:-1][lengths > 0])
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        if len(self.words) > 1_000_000:
            self._forget()
        size = e - s
        places = np.arange(len(cp)) - np.repeat(s, size)
        mixed = (_noise()[cp] + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        h = np.add.reduceat(mixed, s) if len(s) else np.zeros(0, np.uint64)
        distinct, rep, back = np.unique(h, return_index=True, return_inverse=True)
        rep_of = rep[back]
        entry = np.empty(len(distinct), np.int64)
        for i, (key, a, b) in enumerate(zip(distinct.tolist(), s[rep].tolist(), e[rep].tolist())):
            k, word = self.known.get(key), blob[a:b]
            if k is None:
                k = self._learn(key, word)
            elif self.words[k] != word:
                k = self._other(word)
            entry[i] = k
        entry = entry[back]
        # pieces that share a hash with another one are looked up by themselves
        near = np.minimum(np.repeat(s[rep_of], size) + places, max(len(cp) - 1, 0))
        other = (size != size[rep_of]) | np.logical_or.reduceat(cp != cp[near], s) if len(s) else np.zeros(0, bool)
        for i in np.flatnonzero(other).tolist():
            entry[i] = self._other(blob[s[i] : e[i]])
        owner = np.searchsorted(offsets, s, "right") - 1
        per_text = np.bincount(owner, minlength=len(lengths))
        return entry, s, per_text, offsets, cp

    def _other(self, word: str) -> int:
        """The place of a piece whose hash another piece has."""
        if word not in self.others:
            self.others[word] = self._learn(None, word)
        return self.others[word]

    def _strange(self, blob: str, lengths: np.ndarray) -> np.ndarray:
        """Texts with a character that is newer than the class table."""
        at = np.flatnonzero(_classes()[codes(blob)] == UNKNOWN)
        return np.unique(np.searchsorted(np.cumsum(lengths), at, "right"))

    def _apart(self, blob: str, lengths: np.ndarray, odd: np.ndarray) -> tuple[str, np.ndarray, list[np.ndarray]]:
        """The texts without the ``odd`` ones, and the ids of those by the plain tokenizer."""
        ends = np.cumsum(lengths)
        texts = [blob[a:b] for a, b in zip((ends - lengths)[odd].tolist(), ends[odd].tolist())]
        keep, at = [], 0
        for k in odd.tolist():
            keep.append(blob[at : int(ends[k] - lengths[k])])
            at = int(ends[k])
        rest = lengths.copy()
        rest[odd] = 0
        return "".join([*keep, blob[at:]]), rest, [np.array(self.plain.encode_ordinary(t), np.int32) for t in texts]

    def encode(self, blob: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in ``blob`` one behind the other, and how many each text has."""
        odd = self._strange(blob, lengths)
        if len(odd):
            rest, sizes, plain = self._apart(blob, lengths, odd)
            ids, n = self.encode(rest, sizes)
            ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[odd], [len(p) for p in plain]), np.concatenate(plain))
            n[odd] = [len(p) for p in plain]
            return ids, n
        entry, _, per_text, _, _ = self._entries(blob, lengths)
        size = self.size[entry]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.at[entry] - (ends - size), size)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)

    def count(self, blob: str, lengths: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        odd = self._strange(blob, lengths)
        if len(odd):
            rest, sizes, plain = self._apart(blob, lengths, odd)
            n = self.count(rest, sizes)
            n[odd] = [len(p) for p in plain]
            return n
        entry, _, per_text, _, _ = self._entries(blob, lengths)
        ends = np.concatenate([[0], np.cumsum(self.size[entry])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

    def encoded(self, text: str) -> Encoded | None:
        """A text with its pieces; None where a character is newer than the class table."""
        cp = codes(text)
        if (_classes()[cp] == UNKNOWN).any():
            return None
        starts = np.flatnonzero(piece_starts(cp, np.zeros(1, np.int64))) if text else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(text))
        each = [self.piece(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return Encoded(text, starts, firsts, np.concatenate([np.zeros(0, np.int32), *each]))

    def tree(self, leaves: list[Encoded]) -> Encoded:
        """Neighbours joined level by level until one is left."""
        while len(leaves) > 1:
            leaves = [a.join(b, self) for a, b in zip(leaves[::2], leaves[1::2])] + leaves[len(leaves) // 2 * 2 :]
        return leaves[0]


@lru_cache(4)
def bpe(rank_file: str) -> Bpe:
    """The encoder of one worker process."""
    return Bpe(rank_file)
