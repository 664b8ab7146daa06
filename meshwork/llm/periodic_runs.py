"""Periodic runs: stretches of words that repeat with a period, by a sparse diagonal DP.

On the diagonal of lag d, word i is set against word i - d.  A run of smallest period d is a maximal match on that diagonal, as long as the
run is less d; so only diagonals whose match reaches max(least - d, d) words count.  A match of this length begins with as many words as
some `width` of its lag's range needs (half of `least` for the smallest lags, then lags from width to 2 * width), so cells are sparse: a word's earlier
occurrences count where the next width - 1 words agree too, found by sorting.  A diagonal becomes active at a cell that no
match precedes, its match length is incremented as long as words agree (by powers of two, largest first), and it emits a run where
it ends with sufficient length.  Where occurrences overlap by half a width or more they lie within one run of a shorter
period, and none but the first of them can begin a match with another such one; they are compared with first ones only.
So each range of lags has O(n) diagonals, and n words O(n log n), however often a word occurs.  Lags that are multiples of a shorter
period find the same stretch; the smallest stays.

Words are compared by 64 bits of hash.  Each document is one row's work within a task; nothing is shuffled.

Defined results: a null or empty text has no words and no run, and an empty collapsed text; rows that repeat a doc_id each have their own
result; further columns are ignored, whatever their names; an empty table has an empty result; a null doc_id stays null (and
op12's query leaves its words as they are).  Of equally long runs the first is the longest, then that of the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

LEAST = 12
CHUNK = 1 << 21


class _Grams:
    """Whether two stretches of words agree, in constant time: prefix sums over hashes of `k` words each."""

    def __init__(self, h: np.ndarray, k: int):
        self.k = k
        values = tk.runs(h, k, seed=1)
        self.up, self.down = tk.powers(0xD1342543DE82EF95, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, tk.U)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of n words (k at least) from each place on."""
        return tk.mix((self.sums[at + (n - self.k + 1)] - self.sums[at]) * self.down[at])

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and b on are the same: k at least, most at most."""
        got, room = np.zeros(len(a), np.int64), most - (self.k - 1)
        step = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
        while step and len(a):
            some = np.flatnonzero(got + step <= room)
            x, y = a[some] + got[some], b[some] + got[some]
            got[some[(self.sums[x + step] - self.sums[x]) * self.down[x] == (self.sums[y + step] - self.sums[y]) * self.down[y]]] += step
            step >>= 1
        return got + self.k - 1


def _classes(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs again, in the order of keys and places, and the number of each one's class."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    some = np.sort(order[same[1:] | same[:-1]])
    some = some[np.argsort(key[some], kind="stable")]
    k = key[some]
    return at[some], np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from lo[i] to hi[i], and its i."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - lo, n)


def _cells(at: np.ndarray, kind: np.ndarray, least: int, beyond: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags (from least to below beyond) of occurrences with earlier ones of their class, one of them the first in its run."""
    new = np.ones(len(at), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (at[1:] - at[:-1] > width // 2)
    firsts = np.flatnonzero(new)
    room = int(at.max(initial=0)) + 2 * beyond
    key, own = kind * room + at + beyond, (kind * room + at + beyond)[firsts]
    i, j = _spans(np.searchsorted(key, own - beyond + 1), np.searchsorted(key, own - least, "right"))
    a, b = firsts[i], j  # a first one and those before it
    i, j = _spans(np.searchsorted(key, own + least), np.searchsorted(key, own + beyond - 1, "right"))
    later = ~new[j]
    a, b = np.concatenate((a, j[later])), np.concatenate((b, firsts[i[later]]))
    return at[a], at[a] - at[b]


def periodic_runs(h: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, length and period of all runs of some texts' words h (text i has those from first[i] on), in this order; least: words, two or more."""
    none = np.empty(0, np.int64)
    found = [(none,) * 4]
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    last = first[1:][row]
    width = max(1, -(-least // 2))
    if len(h) >= width:
        grams = _Grams(h, min(4, width))
        at = np.flatnonzero(np.arange(len(h)) + width <= last)
        low = 1
        while len(at):
            at, kind = _classes(tk.mix(grams.of(at, width) + row[at].astype(tk.U)), at)
            i, lag = _cells(at, kind, low, 2 * width, width)
            begins = first[row[i]]
            ok = (i - lag == begins) | (h[np.maximum(i - 1, 0)] != h[np.maximum(i - 1 - lag, 0)])
            i, lag, begins = i[ok], lag[ok], begins[ok]
            match = grams.agree(i, i - lag, last[i] - i)
            ok = match >= np.maximum(least - lag, lag)
            i, lag, begins, match = i[ok], lag[ok], begins[ok], match[ok]
            found.append((row[i], i - lag - begins, match + lag, lag))
            low = width = 2 * width
            at = np.sort(at)
            at = at[at + width <= last[at]]
    r, start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start, r))
    r, start, length, period = r[order], start[order], length[order], period[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    r, start, length, period = r[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, r))
    return r[order], start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:-1]) == 0


Rearranged = Callable[[object, int], np.ndarray | None]


def _found(least: int, rearranged: Rearranged | None, summed: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, most=CHUNK):
                yield _of_texts(part, least, rearranged, summed)

    return of


def _of_texts(part: pa.RecordBatch, least: int, rearranged: Rearranged | None, summed: bool) -> pa.RecordBatch:
    words = tk.Words(part.column("text"))
    h, first = words.hashes(), words.first
    n = np.diff(first)
    ids, raw = part.column("doc_id").to_pylist(), words.raw.tobytes()
    orders = [rearranged(d, m) if rearranged and m else None for d, m in zip(ids, n.tolist(), strict=True)]
    for f, order in zip(first[:-1].tolist(), orders, strict=True):
        if order is not None:
            h[f : f + len(order)] = h[f + order]
    r, start, length, period = periodic_runs(h, first, least)
    at = np.searchsorted(r, np.arange(len(n) + 1))
    if not summed:
        text = []
    rows = []
    for i, (m, order) in enumerate(zip(n.tolist(), orders, strict=True)):
        s, e, p = (c[at[i] : at[i + 1]] for c in (start, length, period))
        own = raw[words.at[i] : words.at[i + 1]].split()
        if order is not None:
            own = [own[j] for j in order.tolist()]
        if len(s):
            own = [own[j] for j in np.flatnonzero(kept_words(m, s, e, p)).tolist()]
        short = b" ".join(own)
        if not summed:
            text.append(short.decode())
            continue
        if len(s):
            j = np.lexsort((p, s, -e))[0]
            top = (int(s[j]), int(e[j]), int(p[j]), 1000 * int(e[j]) // int(p[j]))
        else:
            top = (None,) * 4
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), p.tolist(), strict=True)).encode()
        rows.append((len(s), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(short).hexdigest()))
    if summed:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])
    lists = [tk.lists(c, at) for c in (start, length, period)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists, pa.array(text, pa.string())], ["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])


def document_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, starts, lengths, periods (of all runs, by start and period) and collapsed (the text's words, of each run its first period
    only) of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found(least, None, False), f"doc_id {kind}, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")


def run_digests(docs: DataFrame, least: int = LEAST, rearranged: Rearranged | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text; rearranged(doc_id, n) may say which of n words is
    taken at each place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found(least, rearranged, True), f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """Every tenth document by its id's checksum repeats itself from some word on, a third to a tenth of the rest at a time."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's runs, and its text without their repetitions."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rearranged=planted)


# checksum by shifting in one bit after another
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1))), lambda s, b: xor(s >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295)"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
o AS (SELECT r, n, w, a, p, unnest(range(n)) AS i FROM p),
u AS (SELECT r, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS v FROM o),
c AS (SELECT x.r, x.i, x.i - y.i AS lag FROM u x JOIN u y ON x.r = y.r AND x.v = y.v AND x.i > y.i AND x.i - y.i <= x.n // 2),
s AS (SELECT r, lag, min(i) - lag AS start, count(*) + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS m FROM c) GROUP BY r, lag, m),
q AS (SELECT r, start, length, min(lag) AS period FROM s WHERE length >= greatest(12, 2 * lag) GROUP BY r, start, length),
f AS (SELECT r, count(*) AS n_runs, first(q ORDER BY length DESC, start, period) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM q GROUP BY r),
x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM q),
k AS (SELECT u.r, string_agg(v, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN x ON u.r = x.r AND u.i = x.i GROUP BY u.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (r) LEFT JOIN k USING (r)"""
