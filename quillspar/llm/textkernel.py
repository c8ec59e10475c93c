"""Vectorised byte kernels that the text operators share inside Arrow tasks.

Everything here works on one bounded chunk of an Arrow string column at a time
and on the UTF-8 bytes themselves, so that no Python string is made per word:
byte classes come from look-up tables, word boundaries from comparisons of
neighbours, word hashes from mixed blocks of eight bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Arrow batches that tasks send to Python hold about so many bytes.
BATCH_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased bytes: digits, a-z and all non-ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about max_bytes; a longer row stands alone.

    Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def small_batches(spark) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES, where it is larger; it stays so, for results are computed later."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which ends by giving freed memory back to the system: Python workers live on, and what they hold counts beside the JVM's."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the index of its first word (one entry more than rows)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]  # a word doesn't go on over the end of a row
    first[edge] = word[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = word[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_counts(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.diff(word_spans(data, offsets, inside)[2])


#: Keeps the first n of eight bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words are cut into blocks of eight bytes; each is mixed with its place, their sum with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.concatenate((LOWER[data], np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    with np.errstate(over="ignore"):
        found = eight[at] & _MASKS[np.minimum(np.repeat(ends, blocks) - at, 8)]
        found = mix(mix(found) + (place.astype(np.uint64) + np.uint64(1)) * _BASE)
        return mix(np.add.reduceat(found, first) + size.astype(np.uint64) * _BASE)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, spans: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z as a-z), and per row the index of its first word; spans: what word_spans said already.

    A row longer than CHUNK_BYTES is hashed piece by piece, each piece ending
    between two words, so that memory stays at a few words per piece.
    """
    starts, ends, firsts = spans or word_spans(data, offsets, inside)
    if len(data) <= CHUNK_BYTES:
        return _hash_spans(data, starts, ends), firsts
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        out[at:to] = _hash_spans(data[base : int(ends[to - 1])], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out, firsts


@lru_cache(maxsize=32)
def _weights(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(salt)) | np.uint64(1)


def combine(hashes: np.ndarray, at: list[int], salt: int = 0) -> np.ndarray:
    """One hash for each window: of the words at the given places after the window's first."""
    n = len(hashes) - max(at)
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, len(at), dtype=np.uint64)
        for place, weight in zip(at, _weights(len(at), salt), strict=True):
            total += hashes[place : place + n] * weight
        return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is much faster here than numpy's table of them."""
    ordered = np.sort(values)
    keep = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; a shorter row's whole sequence counts as one."""
    windows = combine(hashes, list(range(size)))
    out = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(distinct(windows[lo : hi - size + 1]))
        elif hi > lo:
            out.append(combine(hashes[lo:hi], list(range(hi - lo)), salt=hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def piece_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of pieces that a byte-level BPE with the usual word pattern encodes apart from each other.

    Cuts stand only where that pattern always starts a new match: before one
    space between two visible characters, before and after one line feed
    between such, and before ASCII punctuation after a letter. `|` is left out,
    for it stands inside special strings. Characters count as visible only when
    their bytes show that they are no Unicode space.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n > 2:
        ascii_seen = (data > 0x20) & (data < 0x7F)
        lead = (data >= 0xC3) & (data <= 0xDF)
        tail = np.zeros(n, dtype=bool)  # second byte of such a character
        tail[1:] = lead[:-1]
        before = np.zeros(n, dtype=bool)
        before[1:] = (ascii_seen | tail)[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = (ascii_seen | lead)[1:]
        one = before & after
        row_start = offsets[(offsets > 0) & (offsets < n)]
        one[row_start] = False
        one[row_start - 1] = False
        space, feed = one & (data == 0x20), one & (data == 0x0A)
        low = data | 0x20
        letter = (low >= 0x61) & (low <= 0x7A)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] >= 0x80)
        punctuation = ascii_seen & ~((low >= 0x61) & (low <= 0x7A)) & ~((data >= 0x30) & (data <= 0x39)) & (data != 0x7C)
        cut[:n] |= space | feed
        cut[1:] |= feed
        cut[1:n] |= punctuation[1:] & letter[:-1]
    return np.flatnonzero(cut)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a chunk as an Arrow string array on the same bytes, and per row the index of its first piece."""
    at = piece_offsets(data, offsets)
    array = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return array, np.searchsorted(at, offsets)
