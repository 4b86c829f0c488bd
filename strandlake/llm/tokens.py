"""Token ids of whole texts by a tokenizer file, each distinct piece encoded once per worker.

Both vocabularies used here cut a text into pieces by a pattern before the merges and encode each piece alone, so a
piece's ids are the same wherever it stands. Texts of plain characters (ASCII without apostrophes and controls, Latin
letters up to U+024F, no "<|") are cut here for a whole batch at a time by byte classes, just as the pattern does it;
new pieces go to the tokenizers library, known ones are looked up by their hash. Any other text goes to the library as
a whole. Tests hold both ways against each other.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from . import words

# byte classes of plain texts: white space, letter, digit, other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 39, 127, *range(0xC0, 0xC3), *range(0xCA, 256)]] = True


def odd_places(data: np.ndarray) -> np.ndarray:
    """Indices of bytes that make a text not plain."""
    odd = _ODD[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        odd[:-1] |= (a == 0x3C) & (b == 0x7C)  # "<|" may begin a special token
        lead = np.flatnonzero((a >= 0xC3) & (a <= 0xC9))
        x, y = a[lead], b[lead]
        odd[lead] |= ((x == 0xC3) & ((y == 0x97) | (y == 0xB7))) | ((x == 0xC4) & (y == 0xB0)) | ((x == 0xC9) & (y > 0x8F))
    return np.flatnonzero(odd)


def _class_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes, where they change or a text begins, and where a text begins."""
    c = _CLASS[data]
    edge = np.empty(len(c), bool)
    edge[0] = True
    edge[1:] = c[1:] != c[:-1]
    start = np.zeros(len(c), bool)
    start[offsets[:-1][offsets[:-1] < len(c)]] = True
    return c, edge | start, start


def cut_with_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the byte-level pattern: runs of one class, each with one blank before it; other white space apart."""
    c, edge, start = _class_edges(data, offsets)
    begin = edge.copy()
    blank_before = np.zeros(len(c), bool)
    blank_before[1:] = data[:-1] == 32
    begin &= ~(blank_before & (c != 0)) | start
    # the last white space before other characters stands alone or goes to them
    last = np.zeros(len(c), bool)
    last[:-1] = (c[:-1] == 0) & (c[1:] != 0) & ~start[1:]
    begins = np.flatnonzero(begin | last)
    return begins, np.append(begins[1:], len(data))


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the word pattern: runs of letters or of other characters and single digits, without white space."""
    c, edge, _ = _class_edges(data, offsets)
    begins = np.flatnonzero(edge | (c == 2))
    ends = np.append(begins[1:], len(data))
    keep = c[begins] != 0
    return begins[keep], ends[keep]


def _symbols() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    out = np.arange(256, dtype="<u4")
    other = np.ones(256, bool)
    other[[*range(33, 127), *range(161, 173), *range(174, 256)]] = False
    out[other] = 256 + np.arange(other.sum())
    return out


#: what byte-level vocabularies call the bytes; their pieces go to the library's merges as they are, without its cutting
SYMBOLS = {"byte_bpe_50k.json": _symbols()}

#: how each vocabulary cuts, and whether A-Z count as a-z
KINDS = {"byte_bpe_50k.json": (cut_with_spaces, words.RAW_VALUES), "word_bpe_49k.json": (cut_words, words.BYTE_VALUES)}


class Encoder:
    """Ids of batches of texts. Remembers up to `remembered` pieces, then begins anew; `offsets` adds token ends."""

    def __init__(self, name: str, offsets: bool = False, remembered: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.cut, self.values = KINDS.get(name, (None, None))
        self.symbols = SYMBOLS.get(name)
        self.offsets, self.remembered = offsets, remembered
        self.shift = np.uint64(64 - (2 * remembered - 1).bit_length())
        self._forget()

    def _forget(self) -> None:
        n = 1 << (64 - int(self.shift))
        self.keys, self.slots = np.zeros(n + 64, np.uint64), np.full(n + 64, -1, np.int32)
        self.count, self.used = 0, 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.ends = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18 if self.offsets else 0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others."""
        at = (h >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        step = 0
        while len(open_) and step < 63:
            step += 1
            x = at[open_] + step
            hit = self.keys[x] == h[open_]
            out[open_[hit]] = self.slots[x[hit]]
            open_ = open_[~hit & (self.slots[x] >= 0)]
        return out

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        at = (h >> self.shift).astype(np.int64)
        left = np.arange(len(h))
        for step in range(64):
            x = at[left] + step
            free = self.slots[x] < 0
            cand, first = np.unique(x[free], return_index=True)
            take = left[free][first]
            self.keys[cand], self.slots[cand] = h[take], numbers[take]
            left = np.setdiff1d(left, take, assume_unique=True)
            if not len(left):
                break
        # what found no place within 64 steps is simply not remembered

    def _learn(self, data: np.ndarray, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes pieces by the library and gives their numbers."""
        ids, cuts = [], []
        if self.symbols is not None and not self.offsets:
            text, merged = self.symbols[data].tobytes().decode("utf-32-le"), self.library.model.tokenize
            ids = [[t.id for t in merged(text[a:b])] for a, b in zip(begins.tolist(), ends.tolist())]
        else:
            raw = data.tobytes()
            some = [raw[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist())]
            for k in range(0, len(some), 4096):
                if self.offsets:
                    for e in self.library.encode_batch(some[k : k + 4096], add_special_tokens=False):
                        ids.append(e.ids)
                        cuts += [y for _, y in e.offsets]
                else:
                    ids += [e.ids for e in self.library.encode_batch_fast(some[k : k + 4096], add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int32)
        flat = np.array([y for x in ids for y in x], np.uint32)
        n = self.count + len(ids)
        while n > len(self.size):
            self.begin, self.size = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.size, np.zeros_like(self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
            if self.offsets:
                self.ends = np.append(self.ends, np.zeros_like(self.ends))
        numbers = np.arange(self.count, n, dtype=np.int32)
        self.size[self.count : n] = sizes
        self.begin[self.count : n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        if self.offsets:
            self.ends[self.used : self.used + len(flat)] = cuts
        self.used += len(flat)
        self.count = n
        self._put(h, numbers)
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """All ids in a row, where each text's ids begin (one more entry for the end), and with `offsets` the end of
        each token in characters of its text."""
        if self.count > self.remembered:
            self._forget()
        data, offsets = words.bytes_of(texts)
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        if self.cut is None:
            odd[:] = True
        elif len(data):
            odd[np.searchsorted(offsets, odd_places(data), "right") - 1] = True
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
        if self.cut is None:
            begins = ends = np.zeros(0, np.int64)
        else:
            begins, ends = self.cut(data, offsets)
            if odd.any():
                keep = ~odd[np.searchsorted(offsets, begins, "right") - 1]
                begins, ends = begins[keep], ends[keep]
        number = np.zeros(0, np.int32)
        if len(begins):
            h = words.hashes(data, begins, ends, self.values)
            number = self._find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                u, first, back = np.unique(h[new], return_index=True, return_inverse=True)
                number[new] = self._learn(data, u, begins[new[first]], ends[new[first]])[back]
        sizes = self.size[number].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(sizes)))
        pick = np.repeat(self.begin[number] - total[:-1], sizes) + np.arange(total[-1])
        flat = self.pool[pick]
        starts = total[np.searchsorted(begins, offsets)]
        token_ends = None
        if self.offsets:
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            doc = np.searchsorted(offsets, begins, "right") - 1
            token_ends = np.repeat(chars[begins] - chars[offsets[doc]], sizes) + self.ends[pick]
        if not odd.any():
            return flat, starts, token_ends
        ids, cuts = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])], [token_ends[a:b] for a, b in zip(starts[:-1], starts[1:])] if self.offsets else []
        raw = data.tobytes()
        for i in np.flatnonzero(odd):
            e = self.library.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False)
            ids[i] = np.array(e.ids, np.uint32)
            if self.offsets:
                cuts[i] = np.array([y for _, y in e.offsets], np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids]))), np.concatenate(cuts) if self.offsets else None


def encoder(name: str, offsets: bool = False, remembered: int = 1 << 19) -> Encoder:
    """The worker's encoder of that name, as long as it works for one stage."""
    return words.kept(("encoder", name, offsets, remembered), lambda: Encoder(name, offsets, remembered))
