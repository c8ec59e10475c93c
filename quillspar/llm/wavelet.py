"""Wavelet matrix over token ids: one compressed blob holds a sequence that can be read, counted and searched.

Ids are first numbered by the blob's own sorted alphabet. Bit-plane p holds
bit p (from the top) of all numbers in the order that planes above left them
in: zeros first, then ones, each in their old order. A plane is cut into blocks
of BLOCK bits, each compressed by itself, and the ones before each quarter
block are stored beside it: a step through a plane opens one block of it.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"QWM2"
#: Bits of a block, and of a stretch for which the ones before it are stored.
BLOCK = 1 << 15
STRETCH = 1 << 13
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ids, and each id's place among them in the narrowest type."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        alphabet, codes = np.unique(ids, return_inverse=True)
    else:  # vocabularies are small: a table takes the place of the sort
        alphabet = np.flatnonzero(np.bincount(ids))
        table = np.zeros(int(ids.max()) + 1, np.uint32)
        table[alphabet] = np.arange(len(alphabet))
        codes = table.astype(np.uint16)[ids] if len(alphabet) <= 1 << 16 else table[ids]
    return alphabet, codes.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32, copy=False)


def _stretch_ones(plane: np.ndarray) -> np.ndarray:
    """Ones before each stretch of a packed plane, and in all."""
    step = STRETCH // 8
    padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate(([0], np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.int64))))


def build(ids: np.ndarray) -> bytes:
    """The blob of a sequence of unsigned 32-bit ids: header, sizes of all parts, alphabet, ones before each stretch, blocks of all planes."""
    alphabet, codes = _numbered(ids)
    depth = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    parts, ranks, zeros = [np.ascontiguousarray(alphabet, "<u4").tobytes()], [], []
    for shift in range(depth - 1, -1, -1):
        bits = (codes & codes.dtype.type(1 << shift)).view(np.uint16 if codes.dtype == np.uint16 else np.uint32) != 0
        plane = np.packbits(bits)
        ranks.append(_stretch_ones(plane))
        raw = plane.tobytes()
        parts += [raw[at : at + BLOCK // 8] for at in range(0, len(raw), BLOCK // 8)]
        ones = int(ranks[-1][-1])
        zeros.append(len(codes) - ones)
        if shift:
            after = np.empty_like(codes)
            np.compress(~bits, codes, out=after[: len(codes) - ones])
            np.compress(bits, codes, out=after[len(codes) - ones :])
            codes = after
    parts.insert(1, np.array(ranks, "<u4").tobytes())
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(p) for p in parts]
    head = MAGIC + struct.pack("<QII", len(ids), len(alphabet), depth) + np.array(zeros, "<u8").tobytes()
    return head + np.array([len(p) for p in packed], "<u4").tobytes() + b"".join(packed)


class WaveletMatrix:
    """A blob opened for reading: only the parts that a question needs are decompressed, once."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.blob = blob
        self.n, letters, self.depth = struct.unpack_from("<QII", blob, 4)
        self.zeros = np.frombuffer(blob, "<u8", self.depth, 20).astype(np.int64)
        self.blocks = -(-self.n // BLOCK)
        parts = 2 + self.depth * self.blocks
        begin = 20 + 8 * self.depth
        sizes = np.frombuffer(blob, "<u4", parts, begin).astype(np.int64)
        self.stops = begin + 4 * parts + np.concatenate(([0], np.cumsum(sizes)))
        self.opener = zstandard.ZstdDecompressor()
        self.opened: dict[int, np.ndarray] = {}
        self.alphabet = np.frombuffer(self._part(0), "<u4", letters)
        self._ranks: np.ndarray | None = None

    def _part(self, i: int) -> bytes:
        return self.opener.decompress(self.blob[self.stops[i] : self.stops[i + 1]])

    @property
    def ranks(self) -> np.ndarray:
        """ranks[p, s]: ones of plane p before its stretch s."""
        if self._ranks is None:
            self._ranks = np.frombuffer(self._part(1), "<u4").reshape(self.depth, -1).astype(np.int64)
        return self._ranks

    def _block(self, p: int, b: int) -> np.ndarray:
        """The bytes of one block of a plane."""
        i = 2 + p * self.blocks + b
        if i not in self.opened:
            self.opened[i] = np.frombuffer(self._part(i), np.uint8)
        return self.opened[i]

    def _plane(self, p: int) -> np.ndarray:
        return np.concatenate([self._block(p, b) for b in range(self.blocks)])

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first i bits of plane p."""
        stretch, rest = divmod(i, STRETCH)
        count = int(self.ranks[p, stretch])
        if rest:
            begin = stretch * STRETCH % BLOCK // 8
            whole, bits = divmod(rest, 8)
            block = self._block(p, i // BLOCK)
            count += int(_BITS[block[begin : begin + whole]].sum(dtype=np.int64))
            if bits:
                count += int(_BITS[int(block[begin + whole]) >> (8 - bits)])
        return count

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for p in range(self.depth):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1
            ones = self._ones(p, i)
            code = code << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.depth):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if code >> (self.depth - 1 - p) & 1:
                lo, hi = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id stands in places lo to hi - 1 (rank)."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi = self._range(code, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the id's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self._selected(token, k, k + 1)[0])

    def occurrences(self, token: int) -> list[int]:
        """All places of the id."""
        return self._selected(token, 0, self.count(token)).tolist()

    def _selected(self, token: int, first: int, last: int) -> np.ndarray:
        """Places of occurrences first to last - 1, all carried up the planes together."""
        code = self._code(token)
        if code is None or first >= last:
            return np.zeros(0, np.int64)
        lo, _ = self._range(code, 0, self.n)
        at = np.arange(lo + first, lo + last)
        for p in range(self.depth - 1, -1, -1):
            bit = code >> (self.depth - 1 - p) & 1
            at = self._find(p, at - int(self.zeros[p]) if bit else at, bit)
        return at

    def _find(self, p: int, ks: np.ndarray, bit: int) -> np.ndarray:
        """The places of the ks-th (from 0, ascending) such bits of plane p."""
        ranks = self.ranks[p]
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * STRETCH, self.n) - ranks
        stretches = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        edges = np.flatnonzero(np.diff(stretches, prepend=-1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(ks)], strict=True):
            s = int(stretches[lo])
            begin = s * STRETCH % BLOCK // 8
            bits = np.unpackbits(self._block(p, s * STRETCH // BLOCK)[begin : begin + STRETCH // 8])
            out[lo:hi] = s * STRETCH + np.flatnonzero(bits == bit)[ks[lo:hi] - before[s]]
        return out

    def ids(self) -> np.ndarray:
        """The whole sequence: planes from the last to the first, each sorting back what the one above it sorted."""
        if not self.depth:
            return np.zeros(0, np.uint32)
        kind = np.dtype(np.uint16 if self.depth <= 16 else np.uint32)
        codes = np.zeros(self.n, kind)
        for p in range(self.depth - 1, -1, -1):
            bits = np.unpackbits(self._plane(p), count=self.n).view(bool)
            zeros = int(self.zeros[p])
            back = np.empty(self.n, kind)
            back[~bits] = codes[:zeros]
            back[bits] = codes[zeros:] | kind.type(1 << (self.depth - 1 - p))
            codes = back
        return self.alphabet[codes]
