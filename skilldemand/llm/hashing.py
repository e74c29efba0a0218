"""Tokens of Arrow text columns as 64-bit hashes, in numpy.

A batch of texts is one flat byte buffer. Tokens are runs of bytes that a table maps to
something other than a space; the hash of a token is a sum over its bytes of a random
number of the byte times a random odd number of its position, then mixed. Nothing here
loops over tokens in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\t\n\x0b\x0c\r "
PIECE = 1 << 20  # bytes hashed at a time

_rng = np.random.Generator(np.random.PCG64(20260413))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_NEAR = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_FAR = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_FAR[0] = 1


def byte_table(lower: bool = True, letters_only: bool = False) -> np.ndarray:
    """What each byte counts as: white space becomes a space, A-Z lower case if asked.

    ``letters_only`` also makes ASCII bytes other than letters and digits a space.
    """
    table = np.arange(256, dtype=np.uint8)
    table[list(SPACES)] = 32
    if letters_only:
        plain = [b for b in range(128) if not chr(b).isalnum()]
        table[plain] = 32
    if lower:
        table[65:91] += 32
    return table


WORDS = byte_table(lower=True)
EXACT_WORDS = byte_table(lower=False)
LETTERS = byte_table(lower=True, letters_only=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("").cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), ascending and apart from one another."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(PIECE, lengths.sum() + PIECE, PIECE))
    low = 0
    for high in np.append(cuts + 1, len(starts)):
        high = min(int(high), len(starts))
        if high <= low:
            continue
        size = lengths[low:high]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _BYTE[data[np.repeat(starts[low:high], size) + at]]
        value *= _NEAR[at & 0xFFFF]
        if len(at) and at.max() > 0xFFFF:
            value *= _FAR[(at >> 16) & 0xFFF]
        total = np.zeros(high - low, np.uint64)
        full = size > 0
        if full.any():
            total[full] = np.add.reduceat(value, first[full])
        out[low:high] = mix(total + size.astype(np.uint64))
        low = high
    return out


def tokens(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every token, in order; no token spans two rows."""
    mapped = table[data]
    word = mapped != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(word):
        edge[0], edge[-1] = word[0], word[-1]
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    at = np.flatnonzero(edge)
    if len(at) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = at[:-1], at[1:]
    keep = word[starts]
    starts, ends = starts[keep], ends[keep]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hash_segments(mapped, starts, ends), rows, starts


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's entries begin in a sorted list of row numbers, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(
    hashes: np.ndarray, bounds: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` tokens; a shorter row is one whole run."""
    n_rows = len(bounds) - 1
    size = np.diff(bounds)
    total = len(hashes)
    weights = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(width)]
    parts, owners = [], []
    if total >= width:
        run = np.zeros(total - width + 1, np.uint64)
        for i, weight in enumerate(weights):
            run += mix(hashes[i : total - width + 1 + i] + weight) * (weight | np.uint64(1))
        row = np.repeat(np.arange(n_rows), size)
        inside = row[: total - width + 1] == row[width - 1 :]
        parts.append(mix(run[inside]))
        owners.append(row[: total - width + 1][inside])
    for length in range(1, width):
        short = np.flatnonzero(size == length)
        if len(short):
            run = np.full(len(short), length, np.uint64)
            for i, weight in enumerate(weights[:length]):
                run += mix(hashes[bounds[short] + i] + weight) * (weight | np.uint64(1))
            parts.append(mix(run))
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], owner[order]


def mask_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the window at each position of one text, under a mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, used in enumerate(mask):
        if used == "1":
            weight = np.uint64(((2 * i + 1) * 0x9E3779B97F4A7C15 + salt) % (1 << 64))
            out += mix(tokens[i : i + n] + weight) * (weight | np.uint64(1))
    return mix(out)


def window_hashes(tokens: np.ndarray, rows: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of many texts at once, and the position of each among all tokens."""
    code = mask_hashes(tokens, mask, salt)
    if not len(code):
        return code, np.zeros(0, np.int64)
    inside = np.flatnonzero(rows[: len(code)] == rows[len(mask) - 1 :])
    return code[inside], inside


def slices(texts: pa.Array | pa.ChunkedArray, size: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows of about ``size`` bytes, one row at least."""
    data, offsets = flat(texts)
    n, low = len(offsets) - 1, 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
    # memory of the batch goes back before the next one is read
    del data, offsets
    pa.default_memory_pool().release_unused()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


class Lookup:
    """Values of distinct 64-bit keys, found many at a time in a table with open addresses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys = keys.view(np.uint64)
        self.values = np.append(values, values.dtype.type(0))
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.place = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            lost = self.place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1 where it is not among the keys."""
        keys = keys.view(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        found = self.place[slot]
        left = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found[left] = self.place[slot[left]]
            left = left[(found[left] >= 0) & (self.keys[found[left]] != keys[left])]
        return found

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, 0 where it is not among the keys."""
        return self.values[self.at(keys)]
