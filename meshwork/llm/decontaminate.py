"""Benchmark decontamination: a prefix-filtered join of benchmark windows with the documents' words.

An item's windows are its runs of `window` words (an item of fewer words, but not none, is one window).  To occur in a
document, a window needs all of its words there, so its rarest word alone is a sufficient prefix: words are ordered by
how often they occur in all documents, and only document words that are some window's rarest word are joined.  The
place of the rarest word within the window gives the only possible start, which must leave room for the window within the document
(positional and length bounds).  What is left is verified word by word over the window.

The windows are sent to the tasks in blocks of at most `block` windows.  With more than one, what a block finds is written before
the next is sent, and the block is destroyed; so however large the benchmark is, driver and tasks hold one block.  With one block
documents aren't shuffled.

Words are compared by 64 bits of hash each, ten to a window.  Defined results: a null or empty text has no words; a
null item_id is written as an empty string; rows that repeat an item_id are one item; each row of documents has its own result; of equally rare
words a window's first one is its prefix; without documents there are no rows, without items no hits; other columns are not looked at.
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

WINDOW, BLOCK = 10, 500_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = tk.Words(texts, tk.ALNUM)
    return words.hashes(lower=True), words.first


def _windows(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = _words(batch.column("text"))
            n = np.diff(first)
            m = np.minimum(n, window)
            at = np.concatenate([np.arange(a, b - k + 1) for a, b, k in zip(first[:-1], first[1:], m, strict=True) if k] or [np.empty(0, np.int64)])
            row = np.searchsorted(first, at, "right") - 1
            size = m[row]
            end = np.concatenate(([0], np.cumsum(size)))
            words = h[np.arange(end[-1]) + np.repeat(at - end[:-1], size)]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), tk.lists(words, end)], ["item", "words"])

    return of


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words) of each window of each item, the words as hashes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(_windows(window), "item string, words array<long>").distinct()


def _counted(wanted):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for part in tk.chunks(batch):
                _, at = _found(words, _words(part.column("text"))[0])
                total += np.bincount(at, minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([tk.signed(words[some]), pa.array(total[some])], ["word", "m"])

    return of


def _found(sorted_words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in sorted_words, and where there."""
    if not len(sorted_words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(16, min(24, int(len(sorted_words)).bit_length() + 4))
    seen = np.zeros(1 << bits, bool)
    seen[(sorted_words >> tk.U(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> tk.U(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_words, h[maybe]), len(sorted_words) - 1)
    hit = sorted_words[at] == h[maybe]
    return maybe[hit], at[hit]


class Block:
    """Some windows, by their rarest words: those of prefixes[i] are by[i] to by[i + 1]."""

    def __init__(self, windows: pa.Table, counted: np.ndarray, times: np.ndarray):
        """windows: (item, words); counted: all their words, sorted, and how many times each occurs in the documents."""
        names = pa.chunked_array(windows.column("item").chunks, pa.string()).combine_chunks().dictionary_encode()
        self.items, item = names.dictionary.to_numpy(zero_copy_only=False), names.indices.to_numpy()
        lists = windows.column("words")
        size = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat = pc.list_flatten(lists).to_numpy().view(tk.U)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        words = np.zeros((len(size), size.max(initial=1)), tk.U)
        words[row, place] = flat
        often = np.full(words.shape, np.iinfo(np.int64).max)
        often[row, place] = times[np.searchsorted(counted, flat)]
        rare = often.argmin(1)
        key = words[np.arange(len(size)), rare]
        order = np.argsort(key, kind="stable")
        self.prefixes, by = np.unique(key[order], return_index=True)
        self.by = np.append(by, len(order))
        self.item, self.offset, self.size, self.words = item[order], rare[order], size[order], words[order]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each occurrence's row, first word, number of words, and item."""
        at, p = _found(self.prefixes, h)
        n = self.by[p + 1] - self.by[p]
        w = np.repeat(self.by[p] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        start = np.repeat(at, n) - self.offset[w]
        row = np.searchsorted(first, np.repeat(at, n), "right") - 1
        ok = (start >= first[row]) & (start + self.size[w] <= first[row + 1])
        start, row, w = start[ok], row[ok], w[ok]
        for j in range(self.words.shape[1]):
            ok = (self.size[w] <= j) | (h[np.minimum(start + j, len(h) - 1)] == self.words[w, j])
            start, row, w = start[ok], row[ok], w[ok]
        return row, start, self.size[w], self.item[w]


def blocks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> Iterator:
    """The benchmark's windows as broadcast blocks of at most `block` windows, one at a time, each with whether it is the only one."""
    context = docs.sparkSession.sparkContext
    windows = written(item_windows(benchmark, window).withColumn("b", F.monotonically_increasing_id()))
    n = windows.count()
    parts = max(1, -(-n // block))
    # a block by rank, so that none is larger: ids are ranked by the counts of their partitions
    sizes = {r["p"]: r["count"] for r in windows.groupBy(F.shiftright("b", 33).alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    rank = F.element_at(F.create_map(*[F.lit(x) for p, c in before.items() for x in (p, c)]), F.shiftright("b", 33)) + F.col("b").bitwiseAND((1 << 33) - 1) if before else F.lit(0)
    for i in range(parts):
        own = windows.where((rank >= i * block) & (rank < (i + 1) * block)).select("item", "words").toArrow()
        words = np.unique(pc.list_flatten(own.column("words")).to_numpy().view(tk.U))
        wanted = context.broadcast(words)
        counts = docs.select("text").mapInArrow(_counted(wanted), "word long, m long").groupBy("word").agg(F.sum("m").alias("m")).toArrow()
        wanted.destroy()
        times = np.zeros(len(words), np.int64)
        times[np.searchsorted(words, counts.column("word").to_numpy().view(tk.U))] = counts.column("m").to_numpy()
        yield context.broadcast(Block(own, words, times)), parts == 1


def _marked(block):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                h, first = _words(part.column("text"))
                row, start, size, item = block.value.hits(h, first)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(len(first)))
                names = pa.array(block.value.items.astype(object), pa.string()).take(pa.array(item[order]))
                columns = [tk.lists((start - first[row])[order], at), tk.lists(size[order], at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), names)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(np.diff(first)), *columns], ["doc_id", "key", "n_words", "start", "size", "items"])

    return of


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for start, size, items in zip(*(batch.column(c).to_pylist() for c in ("start", "size", "items")), strict=True):
            words = {w for s, m in zip(start, size, strict=True) for w in range(s, s + m)} if start else ()
            items = sorted(set(items))
            out.append((len(words), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(words) > 0, items))
        hit, n, sha, bad, items = zip(*out, strict=True) if out else ((),) * 5
        columns = [pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    marked = []
    for b, alone in blocks(docs, benchmark, window, block):
        found = rows.mapInArrow(_marked(b), f"doc_id {kind}, key long, n_words long, start array<long>, size array<long>, items array<string>")
        marked.append(found if alone else written(found))
        if not alone:
            b.destroy()
    out = marked[0]
    if len(marked) > 1:
        for more in marked[1:]:
            out = out.union(more)
        gathered = [F.flatten(F.collect_list(c)).alias(c) for c in ("start", "size", "items")]
        out = out.groupBy("doc_id", "key", "n_words").agg(F.count("*").alias("m"), *gathered)
        out = out.withColumn("_", F.explode(F.sequence(F.lit(1), (F.col("m") / len(marked)).cast("int")))).drop("m", "_")
    return out.mapInArrow(_summed, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def _clean(block):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                yield part.filter(pa.array(~_hit(part, block)))

    return of


def _hit(part: pa.RecordBatch, block) -> np.ndarray:
    h, first = _words(part.column("text"))
    hit = np.zeros(part.num_rows, bool)
    hit[block.value.hits(h, first)[0]] = True
    return hit


def _bad(block):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                yield part.filter(pa.array(_hit(part, block))).select(["key"])

    return of


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs in whose text no window of the benchmark occurs, with all their columns.

    One block's look is a filter; with several, each block lists the texts that it hits, and these go by one join.
    """
    texts, bad = docs.select("text", F.sha2("text", 256).alias("key")), None
    for b, alone in blocks(docs, benchmark, window, block):
        if alone:
            return docs.mapInArrow(_clean(b), docs.schema)
        hit = written(texts.mapInArrow(_bad(b), "key string"))
        bad = hit if bad is None else bad.union(hit)
        b.destroy()
    # written, so that Spark can split a text of many copies
    bad = written(bad.distinct().withColumnRenamed("key", "_hit_text"))
    return docs.join(bad, F.sha2(docs["text"], 256) == bad["_hit_text"], "left_anti")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark table occurs in each document."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("items")


_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_FOLD} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_FOLD} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS k
       FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT m FROM bw) WHERE i + m - 1 <= len(w)),
hit AS (SELECT r, i, m, item FROM dw JOIN bw USING (m, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
