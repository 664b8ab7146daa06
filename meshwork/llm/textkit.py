"""Words, shingles and set sketches of Arrow text columns as NumPy arrays.

Everything here is a helper for one Arrow batch inside a Spark task: the texts are read
straight from Arrow's buffers, so that no Python string is made per word.  A null text is
taken as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
LONG_WORD = 256
_STEP, _WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def byte_class(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words of [^\x20\x09-\x0D]+
SPACED = byte_class(b" \t\n\x0b\x0c\r")
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Lines
LINES = byte_class(b"\n")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(_STEP) + U(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(m, base, U), np.full(m, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[base] = got = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return got


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and where each text begins (with the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, at least a row each."""
    _, at = flat(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of some texts: where each begins and ends, and which text has which words.

    raw: the bytes; begin, end: of each word; first: of each text, the first word (with the end).
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray = SPACED):
        self.raw, self.at = flat(texts)
        inside = kind[self.raw]
        opens = np.zeros(len(inside) + 1, bool)
        opens[self.at[:-1]] = True  # a text's end also ends its last word
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        self.begin = np.flatnonzero(inside & (~before | opens[:-1]))
        self.end = np.flatnonzero(inside & (~after | opens[1:])) + 1
        self.first = np.searchsorted(self.begin, self.at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Of each word, its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def bytes(self, i: int) -> bytes:
        return self.raw[self.begin[i] : self.end[i]].tobytes()

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """64 bits for each word; with lower, A-Z count as a-z."""
        up, down = powers(_STEP, len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, U)
        np.cumsum(_byte_values(seed, lower)[self.raw] * up[: len(self.raw)], out=sums[1:])
        size = (self.end - self.begin).astype(U)
        out = mix((sums[self.end] - sums[self.begin]) * down[self.begin] ^ size * U(_WORD_STEP))
        for i in np.flatnonzero(size > LONG_WORD):
            word = self.bytes(i)
            out[i] = int.from_bytes(hashlib.blake2b((word.lower() if lower else word) + seed.to_bytes(8, "big"), digest_size=8).digest(), "big")
        return out


def runs(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64 bits for each k values in a row; shorter than the input by k - 1."""
    if len(values) < k:
        return np.empty(0, U)
    up, down = powers(_WORD_STEP, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(values) - k + 1] + U((seed + k * _STEP) & (2**64 - 1)))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles of each text, a text of fewer words (but not none) as one; the first of each text."""
    n = np.diff(first)
    out, row = runs(hashes, k), np.repeat(np.arange(len(n)), n)
    whole = row[: len(out)] == row[k - 1 :] if len(out) else np.empty(0, bool)
    out, size = out[whole], np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(size)))[short]
        out = np.insert(out, at, [runs(hashes[first[i] : first[i + 1]], int(n[i]))[0] for i in short])
        size[short] = 1
    return out, np.concatenate(([0], np.cumsum(size)))


def _classes(size: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of about one size, and the largest of it: sizes of a power of two at most, and more than half of that."""
    power = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for k in np.unique(power).tolist():
        rows = np.flatnonzero(power == k)
        step = max(1, (1 << 21) >> k)
        for i in range(0, len(rows), step):
            yield rows[i : i + step], int(size[rows[i : i + step]].max())


def _padded(values: np.ndarray, first: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The rows' values as a matrix; what is beyond a row's end is the greatest number."""
    n = (first[1:] - first[:-1])[rows]
    real = np.arange(width) < n[:, None]
    out = np.full(real.shape, ~U(0))
    out[real] = values[np.arange(n.sum()) + np.repeat(first[rows] - (np.cumsum(n) - n), n)]
    return out


def padded_pairs(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers i of pairs of sets a[i] and b[i], and those sets' values as matrices."""
    n = np.diff(first)
    for i, _ in _classes(n[a] + n[b]):
        yield i, _padded(values, first, a[i], int(n[a[i]].max())), _padded(values, first, b[i], int(n[b[i]].max()))


def gathered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Lists of n rows, of parts (rows, their sizes, their values one after another)."""
    size = np.zeros(n, np.int64)
    for rows, each, _ in parts:
        size[rows] = each
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(first[-1], U)
    for rows, each, values in parts:
        out[np.arange(each.sum()) + np.repeat(first[rows] - (np.cumsum(each) - each), each)] = values
    return lists(out, first)


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values once, in order."""
    parts = []
    for rows, width in _classes(np.diff(first)):
        x = _padded(values, first, rows, width)
        x.sort(axis=1)
        new = np.arange(width) < (first[1:] - first[:-1])[rows][:, None]
        new[:, 1:] &= x[:, 1:] != x[:, :-1]
        parts.append((rows, new.sum(1), x[new]))
    out = gathered(parts, len(first) - 1)
    return out.values.to_numpy().view(U), out.offsets.to_numpy().astype(np.int64)


def fast_sketch(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of t coordinates, a row for each set; two sets agree in a coordinate as often as
    their Jaccard similarity says.

    Round i throws each element into a random bin with the value (i, random); a bin keeps its least value.
    Rounds t to 2t-1 throw every element into bin i - t, so that after them each bin is full.  A set stops
    as soon as its bins are full: large sets after a round or two.  Empty sets get all ones.
    """
    n = len(first) - 1
    out = np.full(n * t, ~U(0), U)
    row = np.repeat(np.arange(n), np.diff(first))
    x = values
    for i in range(2 * t):
        if not len(x):
            break
        r = mix(x ^ U(((i + 1) * 0xA24BAED4963EE407) & (2**64 - 1)))
        to = row * t + (((r >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else row * t + (i - t)
        np.minimum.at(out, to, (r >> U(16)) | U(i << 48))
        if i < 3 or i % 8 == 0 or i >= t:  # looking is not free
            open_ = (out.reshape(n, t) == ~U(0)).any(1)[row]
            x, row = x[open_], row[open_]
    return out.reshape(n, t)


def one_permutation(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """One-permutation MinHash signatures of t coordinates, a row for each set that isn't empty.

    Each element goes to one bin, by its hash; a bin keeps its least hash.  An empty bin takes the value of a full one,
    chosen by a random sequence that is the same for all sets (densification).
    """
    n = len(first) - 1
    out = np.full(n * t, ~U(0), U)
    r = mix(values ^ U(0x2545F4914F6CDD1D))
    to, low = r >> U(32), r & U(0xFFFFFFFF)
    to *= U(t)
    to >>= U(32)
    to += np.repeat(np.arange(n, dtype=U) * U(t), np.diff(first))
    r <<= U(32)
    r |= low
    np.minimum.at(out, to.view(np.int64), r)
    row, place = np.divmod(np.flatnonzero(out == ~U(0)), t)
    out = out.reshape(n, t)
    full, turn = out.copy(), 0
    while len(row):
        turn += 1
        got = full[row, (mix(place.astype(U) * U(_STEP) + U(turn)) % U(t)).astype(np.int64)]
        out[row, place] = got
        left = (got == ~U(0)) & (full[row] != ~U(0)).any(1) if turn == 1 else got == ~U(0)
        row, place = row[left], place[left]
    return out


def bands(sketch: np.ndarray, width: int) -> np.ndarray:
    """A key for each `width` coordinates in a row, different for each place."""
    n, t = sketch.shape
    weight = mix(np.arange(1, width + 1, dtype=U) * U(_WORD_STEP)) | U(1)
    key = (sketch.reshape(n, t // width, width) * weight).sum(2, dtype=U)
    return mix(key ^ mix(np.arange(1, t // width + 1, dtype=U) * U(_STEP)))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return sums[first[1:]] - sums[first[:-1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    values = values.view(np.int64) if values.dtype == U else values
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
