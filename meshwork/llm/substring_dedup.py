"""Substring dedup by relative Lempel-Ziv parsing: every word that lies in a window of `window` words that also starts
elsewhere goes.

Index.  Each text is cut into blocks at anchors: the anchor of a window is its k-word gram of least hash, and a block is
the run of windows with one anchor (at most window - k + 1 of them), with the words they span.  Which block a window
falls in depends on its own words only, so equal windows anywhere have equal anchors at equal places.  The index holds
every block of every document; the reference is made of each repeated block's first occurrence, by (doc_id, place).

Parse.  As a block is in the reference once, a document is parsed greedily from left to right: a factor begins at a block that
is in the reference and goes on for as long as the next block is the reference's next one in the same document; so none can be longer.  A factor has
at least `window` words and is a (start, words, reference, reference_start).

Boundaries.  Where an anchor is found again in another block (at a factor's end, where texts begin to differ), the block's
windows are looked up one by one among those of other such blocks; those found lengthen factors or are factors themselves.  An anchor found
nowhere else ends a factor.  So every window that starts elsewhere is in a factor, and no other is.

Per key only counts, least and largest hashes and first places are gathered, with partial sums.  Joins with the index spread the
rows of its `HOT` most frequent keys over `SALTS` parts, so that no key has more than one in `SALTS` of all rows in a part
(a key that isn't among them has at most one in `HOT`).  The documents' texts are shuffled once.

Windows are judged on the input.  Blocks are compared by 128 bits of hash (anchor and words), as are windows.  Defined results: a
null text has no words; rows that repeat a text are documents of their own, also under the same doc_id (the reference names them as one);
no documents give no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import written

WINDOW, GRAM = 35, 8
#: Frequent keys whose rows are spread in joins, and over how many parts
HOT, SALTS = 1024, 128
#: The place of a block's or window's first occurrence
_PLACE = ("doc_id", "key", "at")


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's words: the grams' hashes, and each block's anchor and first window."""
    grams = tk.runs(h, gram, 1)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return grams, at[first], first


def _blocks(window: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(part.column("text"))
                h = words.hashes()
                up, down = tk.powers(tk._STEP, len(h) + 1)
                sums = np.concatenate((np.zeros(1, tk.U), np.cumsum(h * up[: len(h)], dtype=tk.U)))
                rows, out = [], []
                for r, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    if b - a >= window:
                        grams, anchor, first = _anchors(h[a:b], window, gram)
                        m = np.diff(first, append=b - a - window + 1)
                        lo, hi = first + a, first + a + m + window - 1
                        block = tk.mix((sums[hi] - sums[lo]) * down[lo] ^ tk.mix(((anchor - first) * 4096 + m).astype(tk.U)))
                        rows.append(np.full(len(first), r))
                        out.append((grams[anchor], block, first.astype(np.int32), m.astype(np.int32)))
                if rows:
                    row = pa.array(np.concatenate(rows))
                    anchor, block, first, m = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("key").take(row), tk.signed(anchor), tk.signed(block), pa.array(first), pa.array(m)], ["doc_id", "key", "anchor", "block", "at", "m"])

    return of


def _windows(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(part.column("text"))
                w = tk.runs(words.hashes(), window, 2)
                asked = part.column("asked")
                n = np.diff(asked.offsets.to_numpy())
                flat = asked.flatten()
                anchor, at, m = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "at", "m"))
                row = np.repeat(np.repeat(np.arange(part.num_rows), n), m)
                start = np.arange(m.sum()) + np.repeat(at - (np.cumsum(m) - m), m)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("key").take(rows), pa.array(np.repeat(anchor, m).astype(np.int64)), tk.signed(w[words.first[row] + start]), pa.array(start.astype(np.int32))], ["doc_id", "key", "anchor", "words", "at"])

    return of


def _factors(spans: pa.ListScalar, names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's factors: first words, numbers of words, the spans that they begin with, and those spans' places in the reference.

    spans: (at, m, place) each; names: numbers that tell the places' documents apart.
    """
    at, m = (spans.field(c).to_numpy().astype(np.int64) for c in ("at", "m"))
    place = spans.field("place").field("at").to_numpy().astype(np.int64)
    order = np.lexsort((-m, at))
    at, m, place, names = at[order], m[order], place[order], names[order]
    # a window within a span adds nothing
    new = at >= np.concatenate(([-1], np.maximum.accumulate(at + m)[:-1]))
    at, m, place, names, order = at[new], m[new], place[new], names[new], order[new]
    goes_on = (at[1:] == at[:-1] + m[:-1]) & (names[1:] == names[:-1]) & (np.diff(place) == np.diff(at))
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + m[last] - at[first] + window - 1, order[first], place[first]


def _parsed(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                spans = part.column("spans")
                flat = spans.flatten()
                place = flat.field("place")
                # a document of the reference by number: its doc_id and its text's key
                names = np.unique(np.stack([place.field(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("doc_id", "key")], 1), axis=0, return_inverse=True)[1].reshape(-1)
                end = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
                out, factors, of_span = [], [], []
                for text, a, b in zip(part.column("text"), np.append(0, end[:-1]).tolist(), end.tolist(), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n, found = len(words), 0
                    if b > a:
                        start, size, first, at = _factors(flat.slice(a, b - a), names[a:b], window)
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, start, 1)
                        np.add.at(change, start + size, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                        factors.append((start, size, at))
                        of_span.append(first + a)
                        found = len(start)
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), found))
                n, removed, sha, kept, found = zip(*out, strict=True)
                start, size, at = map(np.concatenate, zip(*factors, strict=True)) if factors else (np.empty(0, np.int64),) * 3
                reference = place.field("doc_id").take(pa.array(np.concatenate(of_span) if of_span else np.empty(0, np.int64)))
                lists = pa.StructArray.from_arrays([pa.array(start), pa.array(size), reference, pa.array(at)], ["start", "words", "reference", "reference_start"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(found)).astype(np.int32)), lists)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), lists], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"])

    return of


def _indexed(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with index (one row a key, with the number c of its rows), whose most frequent keys are spread."""
    hot = index.orderBy(F.desc("c"), *keys).limit(HOT).select(*keys, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*_PLACE), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    hot = written(hot)  # at most HOT rows of keys
    mine = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).drop("hot")
    theirs = index.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return mine.join(theirs, [*keys, "salt"]).drop("salt")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, factors of each row of docs (doc_id, text): kept has the words that stay,
    with a space between; factors are (start, words, reference, reference_start) each, in words, the reference a
    doc_id.  A factor that names its own document and start is the one that others refer to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    blocks = rows.mapInArrow(_blocks(window, gram), f"doc_id {kind}, key long, anchor long, block long, at int, m int")
    first = F.min(F.struct(*_PLACE))
    index = blocks.groupBy("anchor").agg(F.count("*").alias("c"), F.min("block").alias("lo"), F.max("block").alias("hi"), first.alias("place")).where("c > 1")
    whole = F.col("lo") == F.col("hi")
    index = written(index.select("anchor", "c", whole.alias("whole"), F.when(whole, F.col("place")).alias("place")))
    found = written(_indexed(blocks, index, ["anchor"]).drop("c"))

    edge = found.where("not whole").drop("place")
    kinds = written(edge.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.min("m").alias("m"), first.alias("place")))
    again = _indexed(edge, kinds.where("c > 1").drop("m"), ["anchor", "block"])
    # of each such block the first occurrence is looked into, window by window
    asked = kinds.select(*[F.col(f"place.{c}").alias(c) for c in _PLACE], "anchor", "m").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "at", "m")).alias("asked"))
    here = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.key").eqNullSafe(F.col("y.key"))
    windows = asked.alias("y").join(rows.alias("x"), here).select("x.doc_id", "x.key", "x.text", "y.asked").mapInArrow(_windows(window), f"doc_id {kind}, key long, anchor long, words long, at int")
    twice = written(windows.groupBy("anchor", "words").agg(F.count("*").alias("c"), first.alias("place")).where("c > 1"))
    single = _indexed(windows, twice, ["anchor", "words"]).withColumn("m", F.lit(1))

    spans = [df.select("doc_id", "key", F.struct("at", "m", "place").alias("span")) for df in (found.where("whole"), again, single)]
    spans = spans[0].union(spans[1]).union(spans[2]).groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))
    out = rows.alias("x").join(spans.alias("y"), here, "left").select("x.doc_id", "x.text", "y.spans")
    factors = f"array<struct<start: long, words: long, reference: {kind}, reference_start: long>>"
    return out.mapInArrow(_parsed(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, factors {factors}")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without the 35-word passages that repeat."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "factors")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM x JOIN twice USING (k)),
words AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
