"""Whole texts to token ids, fast: a text is cut into its pieces with array operations, and each distinct piece is
encoded once and looked up from then on.

A tokenizer's own pattern never lets a merge cross from one piece to the next, so the ids of a text are those of its
pieces. Pieces are found by the classes of code points (letter, number, space, other). Equal pieces of a chunk are brought
together by a hash and compared byte by byte; beyond the chunk a piece is known by its own bytes.
Texts with something that the classes alone don't settle (contractions, special tokens, text that normalization
changes) are handed to the tokenizers library whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import repeat

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points handled at a time, and distinct pieces remembered by a worker before it starts afresh.
CHUNK, REMEMBERED = 400_000, 400_000

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                skip = 0x800
                for lo, hi in ((a, min(b, 0xD800)), (max(a, 0xD800), b)):
                    if lo < hi:
                        by = skip if lo >= 0xD800 else 0
                        table[lo + by : hi + by] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spaced_pieces(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the pieces `` ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+``. first, last: where a text begins and ends."""
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first] = 9
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 9, kind[1:]
    after[last] = 9
    space = kind == SPACE
    blank = cp == 32
    glued = np.zeros(n, bool)  # the character before is the blank that this run takes along
    glued[1:] = blank[:-1]
    glued[first] = False
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != 9)), (before != kind) & ~glued)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def word_pieces(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the pieces ``L+|N|O+``; spaces are left out."""
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first] = 9
    starts = np.flatnonzero((kind != before) | (kind == NUMBER))
    ends = np.append(starts[1:], n)
    words = kind[starts] != SPACE
    return starts[words], ends[words]


_HEADS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes up to which a piece is its own key, and from which it is told by its content at once.
SHORT, LONG = 7, 64


def _windows(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))


def short_keys(raw: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes and number of bytes of each piece of up to seven, in one number."""
    return _windows(raw)[starts] & _HEADS[np.minimum(length, 8)] | length.astype(np.uint64) << np.uint64(56)


def distinct(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal pieces raw[start:stop], and for every piece the number of its kind. Exact.

    Up to seven bytes are their own key, with their number. Longer ones are sorted by a hash and each is compared with the
    first of its hash; should one differ, and beyond 64 bytes anyway, they are told by content.
    """
    window = _windows(raw)
    length = stops - starts
    key = short_keys(raw, starts, length)
    long = np.flatnonzero(length > SHORT)
    if not len(long):
        return np.unique(key, return_index=True, return_inverse=True)[1:]
    at, size = starts[long], length[long]
    eight = lambda k, some: window[at[some] + 8 * k] & _HEADS[np.minimum(size[some] - 8 * k, 8)]
    by_hash = np.flatnonzero(size <= LONG)
    value = window[at] + size.astype(np.uint64)
    for k in range(1, -(-LONG // 8)):
        some = by_hash[size[by_hash] > 8 * k]
        value[some] = _mix(value[some]) + eight(k, some)
    key[long] = np.uint64(255 << 56) | _mix(value) >> np.uint64(8)
    by_content = np.flatnonzero(size > LONG)
    for attempt in range(2):
        if len(by_content):
            kinds: dict[bytes, int] = {}
            numbers = [kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(at[by_content].tolist(), (at + size)[by_content].tolist())]
            key[long[by_content]] = np.uint64(254 << 56) | np.array(numbers, np.uint64)
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        first = where[back[long]]
        same = length[first] == size
        for k in range(-(-LONG // 8)):
            some = by_hash[size[by_hash] > 8 * k]
            same[some] &= eight(k, some) == window[starts[first[some]] + 8 * k] & _HEADS[np.minimum(size[some] - 8 * k, 8)]
        if attempt or same.all():
            return where, back
        by_hash, by_content = np.empty(0, np.int64), np.arange(len(long))


class Encoder:
    """ids of whole texts. ``encode_pieces`` gets the distinct pieces not seen before; ``encode_text`` texts that need it."""

    def __init__(self, cut: Callable, encode_pieces: Callable[[list[str]], list[list[int]]], encode_text: Callable[[str], list[int]], prepare: Callable[[str], str], plain: Callable[[str], bool]):
        self.cut, self.encode_pieces, self.encode_text, self.prepare, self.plain = cut, encode_pieces, encode_text, prepare, plain
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.at, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        for piece, ids in zip(pieces, self.encode_pieces([x.decode() for x in pieces])):
            k = len(self.known)
            if k == len(self.at):
                self.at, self.length = np.resize(self.at, 2 * k), np.resize(self.length, 2 * k)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.used : self.used + len(ids)] = ids
            self.at[k], self.length[k] = self.used, len(ids)
            self.used += len(ids)
            self.known[piece] = k

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of every text; null counts as empty."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        group: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.plain(t):
                out[i] = np.array(self.encode_text(t), np.uint32)
                continue
            t = self.prepare(t)
            if size + len(t) > CHUNK and group:
                self._encode(group, out)
                group, size = [], 0
            group.append((i, t))
            size += len(t)
        if group:
            self._encode(group, out)
        return out

    def _encode(self, group: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        whole = "".join(t for _, t in group)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for _, t in group])
        first = np.r_[0, ends[:-1]]
        kind = classes()[cp]
        starts, stops = self.cut(cp, kind, first, ends - 1)
        raw, a, b = whole.encode(), starts, stops
        if len(raw) > len(cp):  # from characters to bytes
            at = np.r_[0, np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))]
            a, b = at[starts], at[stops]
        where, back = distinct(raw, a, b)
        if len(self.known) > REMEMBERED:
            self._forget()
        pieces = [raw[i:j] for i, j in zip(a[where].tolist(), b[where].tolist())]
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(slots < 0)):
            slots[new] = len(self.known) + np.arange(len(new))
            self._learn([pieces[i] for i in new.tolist()])
        slots = slots[back]
        lengths = self.length[slots]
        total = np.cumsum(lengths)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[slots] - (total - lengths), lengths)
        ids = self.pool[at]
        # the pieces of a text are those that start in it
        upto = np.searchsorted(starts, ends)
        cuts = np.r_[0, total][upto]
        begin = 0
        for (i, _), end in zip(group, cuts):
            out[i] = ids[begin:end]
            begin = end


_CONTRACTION = regex.compile(r"'(?:s|t|re|ve|m|ll|d)")


def _batch(tokenizer) -> Callable[[list[str]], list[list[int]]]:
    return lambda pieces: [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _ended(tokenizer, end: str) -> Callable[[list[str]], list[list[int]]]:
    """Pieces are encoded many at a time, with blanks between, and told apart by the ids that end a word."""
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True
    plainly = _batch(tokenizer)

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(pieces), 4000):
            some = pieces[k : k + 4000]
            ids = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
            # a piece without such an id (of a character that the vocabulary lacks) would shift all others
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts)] if len(cuts) == len(some) else plainly(some)
        return out

    return encode


def _open(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_level(path: str, encode_pieces: Callable[[list[str]], list[list[int]]] | None = None) -> Encoder:
    """An encoder for a byte-level BPE file (blanks belong to the piece that follows)."""
    tokenizer = _open(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    plain = lambda t: not ("'" in t and _CONTRACTION.search(t) or any(s in t for s in specials))
    return Encoder(spaced_pieces, encode_pieces or _batch(tokenizer), whole, lambda t: t, plain)


def word_level(path: str) -> Encoder:
    """An encoder for a BPE file with word ends: NFC, small letters, white space dropped."""
    tokenizer = _open(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids

    def plain(t: str) -> bool:
        if "'" in t and _CONTRACTION.search(t.lower()) or any(s in t for s in specials):
            return False
        # capital sigma and dotted I are the letters that str.lower() changes by context or into two characters
        return t.isascii() or unicodedata.is_normalized("NFC", t) and "Σ" not in t and "İ" not in t

    return Encoder(word_pieces, _ended(tokenizer, "</w>"), whole, str.lower, plain)


_OPENED: dict[tuple, Encoder] = {}


def encoder(kind: str, path: str) -> Encoder:
    """The worker's encoder for a file; it stays open for the next task."""
    if (kind, path) not in _OPENED:
        _OPENED[kind, path] = {"byte": byte_level, "word": word_level}[kind](path)
    return _OPENED[kind, path]
