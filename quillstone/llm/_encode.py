"""Exact, memoised encoding with the tokenizers library.

A tokenizer first cuts a text into pre-tokens and then works on each alone. Corpora repeat their
words, so the ids of every white-space separated piece are kept in a bounded memo for each Python
worker, and the library's model only sees pieces it has not met. Texts for which the cut is not
certain (special-token strings, unusual white space) go through the library whole; pieces with
characters beyond Latin go through the library's full encoder. Results equal a plain ``encode``.

``batch`` does this for whole blocks of texts in NumPy: pieces are spans of the block's bytes, known by a
64-bit hash of bytes and length, and their ids lie in one array. Pieces beyond ``LONGEST`` bytes are not
known by hash but encoded each time.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np

from ._common import FOLD, blocks, prefix_sums, span_hashes

#: Pieces kept in ``Known`` (about 40 bytes each) and their ids, and pieces in a dict (about 200 bytes); a full memo is emptied, so memory stays bounded.
MEMO, IDS, FEW = 1_000_000, 1 << 23, 200_000
#: Bytes of text that are cut at a time: working arrays take some 100 bytes for each.
BYTES = 1 << 18
#: Bytes of a piece that ``Known`` may hold.
LONGEST = 256
#: Little-endian unsigned 32-bit ids.
_WORD = "I" if array("I").itemsize == 4 else "L"
_LITTLE = sys.byteorder == "little"


def _pack(ids) -> bytes:
    a = array(_WORD, ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class _Memo(dict):
    """A dict that computes what it lacks, emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= FEW:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Known:
    """Ids of pieces by 64-bit hash: an open-addressing table over arrays that grows as it fills, emptied when ``MEMO`` pieces or ``IDS`` ids are in it."""

    def __init__(self):
        self._empty()

    def _empty(self) -> None:
        self.bits = 16
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.ids, self.n, self.used = np.zeros(1 << 16, "<u4"), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece number of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            there = self.keys[at]
            hit = there == h[todo]
            out[todo[hit]] = self.rows[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, found: list[bytes], keep: bool = False) -> None:
        """Put in distinct hashes that are not there, with their ids; ``keep``: those that are there stay, even if it is full."""
        more = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) // 4 for x in found], np.int64)
        if not keep and (self.n + len(h) > MEMO or self.used + len(more) > IDS):
            self._empty()
        while self.n + len(h) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(more)] = more
        self.start[self.n : self.n + len(h)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(h)] = size
        if 2 * (self.n + len(h)) > 1 << self.bits:
            full = np.flatnonzero(self.keys)
            keys, rows = self.keys[full], self.rows[full]
            self.bits = (2 * (self.n + len(h)) - 1).bit_length()
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, rows)
        self._put(h, self.n + np.arange(len(h), dtype=np.int32))
        self.n, self.used = self.n + len(h), self.used + len(more)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.keys[at] == 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            now = free & first
            self.keys[at[now]], self.rows[at[now]] = h[todo[now]], rows[todo[now]]
            taken = self.keys[at] != h[todo]
            todo, at = todo[taken], (at[taken] + 1) & ((1 << self.bits) - 1)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin bytes stand for themselves, the others are counted up from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(keep)]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Encoder:
    """``ids(text)`` gives a text's ids as little-endian uint32 bytes, without special tokens."""

    def __init__(self, path: str):
        import os
        import re

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        if hasattr(self.model, "_resize_cache"):  # the memos below take its place
            self.model._resize_cache(0)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]
        if cut["type"] == "Sequence":  # lower-cased words, white space dropped
            self.drops_space = True
            pattern = cut["pretokenizers"][0]["pattern"]["Regex"]
        else:  # byte-level: a space belongs to what follows it
            self.drops_space = False
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.cut = regex.compile(pattern)
        #: Here lower-casing, NFC and the classes of letters and digits are the same in every library.
        self.plain = regex.compile(r"[\x00-\x1b\x20-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u0180]*").fullmatch
        odd = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000"
        self.odd_space = re.compile(f"[{odd}]" if self.drops_space else f"[\\t\\x0b-\\r{odd}]").search
        self.letters = _byte_letters()
        self.pieces = _Memo(self._piece)
        self.known = Known()

    def _pre_token(self, s: str) -> bytes:
        return _pack([t.id for t in self.model.tokenize(s.encode("utf-8").decode("latin-1").translate(self.letters))])

    def _whole(self, text: str) -> bytes:
        return _pack(self.full.encode(text, add_special_tokens=False).ids)

    def _cut_up(self, s: str) -> bytes:
        if not self.plain(s):
            return self._whole(s)
        return b"".join(map(self._pre_token, self.cut.findall(s.lower() if self.drops_space else s)))

    def _piece(self, s: str) -> bytes:
        """The ids of a piece: the empty one and ``" "`` cannot come up, as pieces start or end at a lone separator."""
        if s.isascii() and s.lstrip(" ").isalpha():  # most pieces
            return array(_WORD, [t.id for t in self.model.tokenize(s.lower() if self.drops_space else s.replace(" ", "\u0120"))]).tobytes() if _LITTLE else self._pre_token(s.lower() if self.drops_space else s)
        if self.plain(s) and s.lstrip(" ").isalpha():
            return self._pre_token(s.lower() if self.drops_space else s)
        return self._cut_up(s)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        kinds = _KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        pairs = _SEEN[(kinds[:-1] << 2) | kinds[1:]]
        #: A comma or full stop that touches no other punctuation is a pre-token of its own.
        lone = not (pairs & _PUNCTUATION).any() and not kinds.max() == _ODD and not any(map(text.__contains__, "\u00d7\u00f7\u0130"))
        if self.drops_space:
            if self.odd_space(text):
                return self._whole(text)
            if lone:
                text = text.lower().replace(",", " ,").replace(".", " .")
            return b"".join(map(self.pieces.__getitem__, text.split()))
        if (pairs & _SPACE).any() or kinds[0] == 1 or kinds[-1] == 1 or "\0" in text or self.odd_space(text):
            return self._cut_up(text)
        text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if lone and not (pairs & _BOTH).any():
            text = text.replace(",", "\0,").replace(".", "\0.")
        return b"".join(map(self.pieces.__getitem__, filter(None, text.split("\0"))))


    def batch(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (each followed by ``end``, if given), and where each text's begin and end."""
        parts, sizes, last = [], [0], [] if end is None else np.array([end], "<u4")
        for at, raw in blocks(texts, BYTES):
            ids, bounds = self._block(texts[at : at + len(raw)], raw)
            n = np.diff(bounds)
            if end is not None:
                out = np.empty(len(ids) + len(n), "<u4")
                where = bounds[1:] + np.arange(len(n))
                keep = np.ones(len(out), bool)
                keep[where] = False
                out[keep], out[where] = ids, last[0]
                ids, n = out, n + 1
            parts.append(ids)
            sizes += n.tolist()
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.cumsum(sizes)

    def _block(self, texts: list[str | None], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"a".join(raw) + b"a", np.uint8)  # a letter stands between texts, in no piece
        if self.drops_space:
            data = FOLD[data]
        size = np.array([len(r) for r in raw])
        first = np.cumsum(size + 1) - (size + 1)
        border = np.zeros(len(data) + 1, bool)
        border[first + size] = True
        kinds = _KIND[data]
        kinds[first + size] = 0
        seen = np.zeros(len(data), np.uint8)
        seen[:-1] = _SEEN[(kinds[:-1] << 2) | kinds[1:]]
        flags, odd = np.bitwise_or.reduceat(seen, first), np.maximum.reduceat(kinds, first) == _ODD
        block = data.tobytes()
        rare = any(x in block for x in (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0"))
        lone = (flags & _PUNCTUATION) == 0
        if rare:
            odd |= np.array([b"<|" in r for r in raw])
            lone &= ~np.array([b"\xc3\x97" in r or b"\xc3\xb7" in r or b"\xc4\xb0" in r for r in raw])
        if not self.drops_space:
            odd |= (flags & _SPACE) > 0
            odd |= (size > 0) & ((kinds[first] == 1) | (kinds[np.maximum(first + size - 1, 0)] == 1))
            lone &= (flags & _BOTH) == 0
        spread = lambda of: np.repeat(of, size + 1)
        inside = ~border[:-1] & spread(~odd)
        stop = ((data == 0x2C) | (data == 0x2E)) & spread(lone)
        begins = np.ones(len(data), bool)
        if self.drops_space:
            inside &= kinds != 1
            begins[1:] = stop[1:] | ~inside[:-1]
        else:
            begins[1:] = stop[1:] | (kinds[1:] == 1) | (data[:-1] == 0x0A) | ~inside[:-1]
        begins &= inside
        starts = np.flatnonzero(begins)
        after = np.append(~inside[1:] | begins[1:], True)
        ends = np.flatnonzero(inside & after) + 1
        h = span_hashes(prefix_sums(data), starts, ends)
        np.maximum(h, np.uint64(1), out=h)
        long = ends - starts > LONGEST
        row = self.known.find(h)
        if len(new := np.flatnonzero((row < 0) & ~long)):
            each, at = np.unique(h[new], return_index=True)
            at = new[at]
            for k in range(0, len(each), MEMO // 4):  # (a block has fewer pieces, as a rule)
                self.known.add(each[k : k + MEMO // 4], [self._piece(block[a:b].decode("utf-8")) for a, b in zip(starts[at[k : k + MEMO // 4]].tolist(), ends[at[k : k + MEMO // 4]].tolist())])
            row = self.known.find(h)
            if (row[~long] < 0).any():  # the memo was emptied in between
                lost = np.flatnonzero((row < 0) & ~long)
                each, at = np.unique(h[lost], return_index=True)
                self.known.add(each, [self._piece(block[a:b].decode("utf-8")) for a, b in zip(starts[lost[at]].tolist(), ends[lost[at]].tolist())], keep=True)
                row = self.known.find(h)
        n = np.where(row >= 0, self.known.size[row], 0).astype(np.int64)
        upto = np.cumsum(n)
        at = np.repeat(self.known.start[row] - (upto - n), n) + np.arange(int(n.sum()))
        ids = self.known.ids[at]
        edge = np.searchsorted(starts, np.append(first, len(data)))
        bounds = np.concatenate([[0], upto])[edge]
        if not (odd.any() or long.any()):
            return ids, bounds
        own = odd.copy()
        own[np.searchsorted(first, starts[long], "right") - 1] = True
        out = [np.frombuffer(self.ids(t), "<u4") if o else ids[a:b] for t, o, a, b in zip(texts, own.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]
        return np.concatenate(out), np.cumsum([0, *map(len, out)])


# Kinds of bytes: 0 letters and digits (with the lead and later bytes of U+00C0 to U+017F), 1 space or line feed,
# 2 ASCII punctuation, 3 anything else.
_ODD = 3
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3:0xC6] = 0
_KIND[[0x20, 0x0A]] = 1
#: What a pair of neighbours shows: punctuation runs, runs of white space, white space before punctuation.
_PUNCTUATION, _SPACE, _BOTH = 1, 2, 4
_SEEN = np.zeros(16, np.uint8)
_SEEN[[10, 11, 14]] = _PUNCTUATION
_SEEN[5] = _SPACE
_SEEN[6] = _BOTH


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """This worker's encoder of a public tokenizer file."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = Encoder(public_tokenizers.path(name))
    return _ENCODERS[name]
