"""Words of UTF-8 texts by whole arrays of bytes: where they are, and 64-bit hashes of words and word sequences.

Also sets of such hashes: summed counts, and a bitmap of bounded size that says which hashes may belong to a set.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import CAPITALS

LEAST_BITS, MOST_BITS, PAGE_BITS = 16, 28, 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[[ord(c) for c in CAPITALS]] += 32


def byte_kinds(blanks: str, piece_ends: str) -> np.ndarray:
    """Per byte: 0 in words, 1 between words, 2 between pieces; all separators are ASCII."""
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in blanks]] = 1
    out[[ord(c) for c in piece_ends]] = 2
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=4)
def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse."""
    return tuple(np.cumprod(np.full(n, f % (1 << 64), np.uint64)) for f in (factor, pow(factor, -1, 1 << 64)))


class Words:
    """Lower-cased words of one window: where they begin and end, their pieces, and hashes of the words."""

    # two independent hashes: factors that have an inverse, and a number per byte
    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, data: np.ndarray, starts: np.ndarray, kinds: np.ndarray, hashes: int = 1):
        self.low = LOWER[data]
        kind = kinds[data]
        word = kind == 0
        starts = starts[starts < len(data)]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[starts] = word[starts]
        last[starts[starts > 0] - 1] = word[starts[starts > 0] - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = (kind == 2).astype(np.int32)
        breaks[starts] += 1
        self.piece = np.cumsum(breaks, dtype=np.int32)[self.begin]
        self.hashes = [self._hash(f) for f in self.FACTORS[:hashes]]

    def _hash(self, factor: int) -> np.ndarray:
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))
        powers, back = _powers(factor, 1 << max(len(self.low) - 1, 0).bit_length())
        total = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(value[self.low] * powers[: len(self.low)], out=total[1:])
        return mix((total[self.end] - total[self.begin]) * back[self.begin])

    def grams(self, longest: int, seed: int, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length: a hash at every word that has a next one so far on, and whether the phrase lies in one piece."""
        word = self.hashes[which]
        h = mix(word + np.uint64(seed))
        inside = np.ones(len(word), bool)
        for k in range(1, longest + 1):
            if k > 1:
                if len(word) < k:
                    return
                h = mix(h[:-1] * np.uint64(self.FACTORS[1]) + word[k - 1 :])
                inside = self.piece[k - 1 :] == self.piece[: len(word) - k + 1]
            yield k, h, inside


def windows(texts: pa.Array, most: int, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, bytes and starts of texts, in windows of about ``most`` bytes that end where a text or a piece ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = end
        if end - at > most:
            stop = int(offsets[np.searchsorted(offsets, at + most, "right") - 1])
            if stop <= at:  # one text is longer than a window
                own = int(offsets[np.searchsorted(offsets, at, "right")])
                stop, size = own, most
                while at + size < own:
                    ends = np.flatnonzero(kinds[data[at : at + size]] == 2)
                    if len(ends):
                        stop = at + int(ends[-1]) + 1
                        break
                    size *= 2
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)]
        yield at, data[at:stop], np.unique(np.r_[0, inner - at])
        at = stop


def summed(hashes: "list[np.ndarray]", counts: "list[np.ndarray]") -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with their summed counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


class Bitmap:
    """Which hashes may belong to a set, by their leading bits."""

    def __init__(self, bits: int, pages: "list[tuple[int, bytes]]"):
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << max(bits - 3, 0), np.uint8)
        for page, body in pages:
            self.bits[page * len(body) : (page + 1) * len(body)] = np.frombuffer(body, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame) -> Bitmap:
    """The bitmap of a stored column ``hash``: 16 bits and more per hash up to ``MOST_BITS`` in all, which bounds it."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))

    def page(rows: pa.Table) -> pa.Table:
        at = rows.column("hash").to_numpy().astype(np.uint64) >> np.uint64(64 - bits)
        set_ = np.zeros(1 << PAGE_BITS, bool)
        set_[(at & np.uint64((1 << PAGE_BITS) - 1)).astype(np.int64)] = True
        return pa.table({"page": [int(at[0]) >> PAGE_BITS], "body": pa.array([np.packbits(set_, bitorder="little").tobytes()], pa.binary())})

    key = F.shiftrightunsigned("hash", 64 - bits + PAGE_BITS) if bits > PAGE_BITS else F.lit(0).cast("long")
    pages = hashes.select("hash", key.alias("page")).groupBy("page").applyInArrow(page, "page long, body binary")
    return Bitmap(bits, [(r.page, bytes(r.body)) for r in pages.collect()])  # 8 kB each, 32 MB in all
