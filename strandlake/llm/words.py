"""Words of whole batches of texts as numpy arrays of 64-bit hashes.

A word's hash sums its blocks of eight bytes, each mixed with its place in the word by a bijection without linear
structure, and mixes the sum with the length; equal words always have equal hashes. The function is fixed and not keyed:
for texts that were not made against it, two different words or shingles share a hash with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

RAW_VALUES = np.arange(256, dtype=np.uint8)
BYTE_VALUES = RAW_VALUES.copy()
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]  # A-Z count as a-z
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: the first n bytes of a block
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: white space of the join's words: 0x20 and 0x09-0x0D
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, *range(9, 14)]] = False
#: 0-9, A-Z, a-z and all bytes of characters beyond ASCII
LETTER_WORDS = np.zeros(256, bool)
LETTER_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # other C libraries give memory back themselves
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on through stages with other needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_held: dict = {}
_stage: list[int | None] = [None]


def let_go() -> None:
    """Drops what kept() holds for another stage."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _stage[0]:
        _stage[0] = stage
        if _held:
            _held.clear()
            give_back()


def kept(key, make):
    """What make() gives, held as long as the worker works for the same stage."""
    let_go()
    if key not in _held:
        _held[key] = make()
        give_back()  # what making it took
    return _held[key]


def pieces(batch: pa.RecordBatch, column: str, budget: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `budget` bytes (a longer text is a slice of its own)."""
    let_go()
    i = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + budget, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the index of each text's first word (one more entry for the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = kind[data]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[inner - 1] = False
    begins = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """The hash of every word; with RAW_VALUES capitals count as different."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = values[data]
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from every place on
    size = ends - begins
    h = mix((blocks[begins] & _MASKS[np.minimum(size, 8)]) + _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # blocks after the first
        first = np.cumsum(more) - more
        nth = np.arange(first[-1] + more[-1]) - np.repeat(first, more) + 1
        at = np.repeat(begins[long], more) + 8 * nth
        x = blocks[at] & _MASKS[np.minimum(np.repeat(ends[long], more) - at, 8)]
        h[long] += np.add.reduceat(mix(x + (nth + 1).astype(np.uint64) * _PLACE), first)
    return mix(h + size.astype(np.uint64) * _PLACE)


def word_hashes(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the index of each text's first word."""
    data, offsets = bytes_of(texts)
    begins, ends, first = spans(data, offsets, kind)
    return hashes(data, begins, ends), first


_STEP = np.uint64(0xD6E8FEB86659FD93)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (also those over a text's end)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : j + n]
    return mix(out + np.uint64(k))


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles over SPACE_WORDS; fewer words: the whole sequence as one."""
    h, first = word_hashes(texts, SPACE_WORDS)
    r = runs(h, k)
    out = []
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= k:
            s = np.sort(r[lo : hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            out.append(runs(h[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def winnow(r: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Places of hashes that are the smallest in some window of neighbours; the others are only compared."""
    top = np.iinfo(np.uint64).max
    x = np.concatenate((np.full(window - 1, top, np.uint64), np.where(valid, r, top), np.full(window - 1, top, np.uint64)))
    least = x
    for j in range(1, window):
        least = np.minimum(least[:-1], x[j:])
    most = least
    for j in range(1, window):
        most = np.maximum(most[:-1], least[j:])
    return np.flatnonzero((most == r) & valid)
