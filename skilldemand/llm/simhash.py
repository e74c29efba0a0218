"""SimHash fingerprints of Arrow text columns, in numpy.

The hash of a shingle is XXH64 of its words with one space between them. Shingles below 32
bytes, which most are, are hashed many at a time; longer ones by the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from skilldemand.llm import hashing as H

SEED = 42
# fixed values of XXH64
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)
SHORT = 32  # bytes from which XXH64 reads stripes

#: the bits of each byte, spread over the eight bytes of a word
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_short(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte ranges below 32 bytes; ``data`` has 8 bytes after the last of them."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.uint64(seed) + P5 + sizes.astype(np.uint64)
    at, left = starts.copy(), sizes.copy()
    for _ in range(3):
        more = np.flatnonzero(left >= 8)
        if not len(more):
            break
        lane = np.ascontiguousarray(words[at[more]]).view("<u8").ravel()
        h[more] = rotl(h[more] ^ (rotl(lane * P2, 31) * P1), 27) * P1 + P4
        at[more] += 8
        left[more] -= 8
    more = np.flatnonzero(left >= 4)
    lane = np.ascontiguousarray(words[at[more], :4]).view("<u4").ravel().astype(np.uint64)
    h[more] = rotl(h[more] ^ (lane * P1), 23) * P2 + P3
    at[more] += 4
    left[more] -= 4
    for _ in range(3):
        more = np.flatnonzero(left > 0)
        if not len(more):
            break
        h[more] = rotl(h[more] ^ (data[at[more]].astype(np.uint64) * P5), 11) * P1
        at[more] += 1
        left[more] -= 1
    return avalanche(h)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    small = np.flatnonzero(sizes < SHORT)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for low in range(0, len(small), 1 << 18):
        some = small[low : low + (1 << 18)]
        out[some] = xxh64_short(padded, starts[some], sizes[some], seed)
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(sizes >= SHORT):
        out[i] = xxhash.xxh64_intdigest(view[starts[i] : ends[i]], seed)
    return out


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with one space after each word: bytes, starts and ends of the words, their rows."""
    mapped = H.WORDS[data]
    word = mapped != 32
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = word.copy()
    first[1:] &= ~word[:-1] | (row[1:] != row[:-1])
    at = np.flatnonzero(word)
    rank = np.cumsum(first[at]) - 1  # word that each kept byte belongs to
    n_words = int(rank[-1]) + 1 if len(rank) else 0
    out = np.full(len(at) + n_words, 32, np.uint8)
    out[np.arange(len(at)) + rank] = mapped[at]
    sizes = np.bincount(rank, minlength=n_words)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return out, starts, starts + sizes, row[np.flatnonzero(first)]


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each row's hashes have each bit set: an array of rows by 64."""
    n = len(bounds) - 1
    out = np.zeros((n, 64), np.int64)
    if not len(hashes):
        return out
    # runs of at most 255 hashes of one row, so that sums of bits fit a byte
    runs = [np.arange(a, b, 255) for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
    cuts = np.concatenate(runs)
    row = np.repeat(np.arange(n), [-(-(b - a) // 255) for a, b in zip(bounds[:-1], bounds[1:])])
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for i, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        sums = np.add.reduceat(SPREAD[column], cuts).view(np.uint8).reshape(-1, 8)
        out[row[first], 8 * i : 8 * i + 8] = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    return out


def fingerprints(texts: pa.Array, width: int = 3, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text's ``width``-word shingles, repeats included.

    Words are runs of bytes other than white space, A-Z in lower case. A text with fewer
    words has its whole sequence as its only shingle; one without words, or null, has 0.
    A bit is set where more than half of the shingles' hashes have it.
    """
    out = np.zeros(len(texts), np.uint64)
    for low, data, offsets in H.slices(texts, 1 << 20):
        n = len(offsets) - 1
        joined, starts, ends, rows = joined_words(data, offsets)
        bounds = H.row_bounds(rows, n)
        size = np.diff(bounds)
        many = np.maximum(size - width + 1, np.minimum(size, 1))  # shingles of each row
        at = np.repeat(bounds[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        last = np.minimum(at + width, np.repeat(bounds[1:], many)) - 1
        hashes = xxh64(joined, starts[at], ends[last], seed)
        counts = bit_counts(hashes, np.append(0, np.cumsum(many)))
        bits = (2 * counts > many[:, None]).astype(np.uint8)
        out[low : low + n] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out
