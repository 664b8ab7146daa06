"""Ranked lexical search in K2-treaps over the grid of terms and documents.

The grid has a row for each term and a column for each document; a cell's value is the term's impact there.  Documents come in shards; a
shard's treap is a quadtree over its grid that has only cells that aren't empty: each node has four bits for its quadrants, the
number of children before its own (so places follow from ranks), and the greatest impact within.

An item's query descends the paths of all its terms' rows together.  An entry is a range of documents with the node of each path there;
the sum of the nodes' greatest impacts, times the terms' weights, bounds the score of every document of the range.
Each item takes its entries of the highest bounds first and halves their ranges; a range of one document has its exact score.
Entries whose bound is below the item's k-th best score so far are dropped, none whose bound equals it, since
a tie may have a smaller doc_id.  So results are exact.  Many items descend together, some entries of each at a time, as arrays.

Terms that no item has need no rows: a shard's grid has the items' terms (at most about MOST_TERMS; more items go in further rounds,
each with its own pass), and all documents with one of them.  Counts that weights and lengths need cover all documents.
The shards are written and read again; each task returns k documents an item at most.

Terms are compared by 64 bits of hash.  Defined results: null or empty texts have no terms, items without terms no results; rows of items that are
alike are one item; rows that repeat a doc_id are documents of their own, with ranks of their own; a null doc_id comes after all others
of its score; further columns are ignored, whatever their names; without documents there are no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .shared import written

#: Maximal matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+
TERMS = tk.byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
K, SHARD, MOST_TERMS, ITEMS_AT_ONCE, ENTRIES = 20, 8192, 1 << 18, 32, 16
NO_ID = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = tk.Words(batch.column("text"), TERMS)
        h = words.hashes(lower=True)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), tk.lists(h, words.first)], ["item_id", "terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of each item, its terms as hashes, repeats included."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").distinct().mapInArrow(_item_terms, f"item_id {kind}, terms array<long>")


SHARDS = "n_docs long, n_terms long, ids array<long>, sizes array<long>, rows array<int>, cols array<int>, tf array<long>"


def _shards(terms):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        seen = np.zeros(1 << 20, bool)
        seen[(known >> tk.U(44)).astype(np.int64)] = True
        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                batch, before, parts, sizes = whole.slice(at, SHARD), 0, [], []
                for part in tk.chunks(batch):
                    words = tk.Words(part.column("text"), TERMS)
                    h, first = words.hashes(lower=True), words.first
                    maybe = np.flatnonzero(seen[(h >> tk.U(44)).astype(np.int64)])
                    term = np.minimum(np.searchsorted(known, h[maybe]), max(len(known) - 1, 0))
                    ok = known[term] == h[maybe] if len(known) else np.zeros(0, bool)
                    doc = np.searchsorted(first, maybe[ok], "right") - 1 + before
                    parts.append(np.unique((doc << 32) + term[ok], return_counts=True))
                    sizes.append(np.diff(first))
                    before += part.num_rows
                key, tf = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
                n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
                # columns in the order of doc_id, those without any of the terms left out
                used = np.unique(key >> 32)
                ids = batch.column("doc_id").take(pa.array(used))
                order = np.lexsort((ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
                place = np.zeros(before, np.int64)
                place[used[order]] = np.arange(len(used))
                column = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int((n > 0).sum())]),
                        pa.array([int(n.sum())]),
                        column(ids.take(pa.array(order)).cast(pa.int64()), None),
                        column(n[used[order]], pa.int64()),
                        column(key & 0xFFFFFFFF, pa.int32()),
                        column(place[key >> 32], pa.int32()),
                        column(tf, pa.int64()),
                    ],
                    [f.split()[0] for f in SHARDS.split(", ")],
                )

    return of


def _frequencies(n: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("rows").values.to_numpy(), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return of


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The part of a score that depends on the document: its term's occurrences tf and its size n."""
    m = 75 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i in range(bits):
        out |= ((x >> i) & 1) << (2 * i)
    return out


class Treap:
    """The quadtree of a grid's cells (row, col, value), one at least, from the root on: of each node its quadrants' bits, first child and greatest value."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray):
        self.bits = max(int(x.max(initial=0)).bit_length() for x in (row, col))
        code = _spread(row, self.bits) << 1 | _spread(col, self.bits)
        order = np.argsort(code)
        code, top = code[order], value[order]
        levels = [(np.zeros(len(code), np.uint8), top)]
        for _ in range(self.bits):
            up = code >> 2
            at = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
            mask, top = np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), at), np.maximum.reduceat(top, at)
            code = up[at]
            levels.append((mask, top))
        self.mask = np.concatenate([m for m, _ in reversed(levels)])
        self.top = np.concatenate([t for _, t in reversed(levels)])
        count = BITS[self.mask].astype(np.int64)
        self.first = 1 + np.cumsum(count) - count

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The child of each node in a quadrant; -1 where it's empty."""
        mask = self.mask[node]
        return np.where((mask >> quadrant) & 1, self.first[node] + BITS[mask & ((1 << quadrant) - 1)], -1)


#: How many bits four bits have
BITS = np.array([bin(i).count("1") for i in range(16)], np.uint8)


class _Best:
    """Of each item the k best documents so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc, self.null = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[rank < self.k]
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[keep], doc[keep], null[keep]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.item[full]] = np.maximum(self.score[full], 1)


def _search(treap: Treap, items: np.ndarray, first: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: _Best, ids: np.ndarray, nulls: np.ndarray) -> None:
    """Adds the best documents of a shard for some items: items[i] has the rows and weights from first[i] on."""
    size = np.diff(first)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return
    item, level, col, n = items[some], np.full(len(some), treap.bits), np.zeros(len(some), np.int64), size[some]
    node, row, weight = np.zeros(len(rows), np.int64), rows, weights
    bound = np.add.reduceat(treap.top[node].astype(np.int64) * weight, first[some])
    entries = ENTRIES
    while len(item):
        # of each item's entries, those with the highest bounds are halved; the others wait
        order = np.lexsort((-bound, item))
        own = item[order]
        now = np.zeros(len(item), bool)
        now[order[np.arange(len(own)) - np.searchsorted(own, own) < entries]] = True
        entries = min(2 * entries, 1 << 12)
        path = np.repeat(now, n)
        e_item, e_level, e_col, e_n = item[now], level[now], col[now], n[now]
        p_node, p_row, p_weight = node[path], row[path], weight[path]
        of = np.repeat(np.arange(len(e_item)), e_n)
        leaf = e_level == 0
        if leaf.any():
            best.add(e_item[leaf], bound[now][leaf], ids[e_col[leaf]], nulls[e_col[leaf]])
        parts = [(item[~now], level[~now], col[~now], n[~now], bound[~now], node[~path], row[~path], weight[~path])]
        inner = ~leaf[of]
        of, p_node, p_row, p_weight = of[inner], p_node[inner], p_row[inner], p_weight[inner]
        low = e_level[of] - 1
        upper = ((p_row >> np.maximum(low, 0)) & 1) << 1
        for half in (0, 1):
            to = treap.child(p_node, upper + half)
            ok = to >= 0
            o, to, r, w = of[ok], to[ok], p_row[ok], p_weight[ok]
            if not len(o):
                continue
            at = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            sums, e = np.add.reduceat(treap.top[to].astype(np.int64) * w, at), o[at]
            parts.append((e_item[e], e_level[e] - 1, 2 * e_col[e] + half, np.diff(np.append(at, len(o))), sums, to, r, w))
        item, level, col, n, bound, node, row, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
        alive = bound >= best.least[item]
        path = np.repeat(alive, n)
        item, level, col, n, bound, node, row, weight = item[alive], level[alive], col[alive], n[alive], bound[alive], node[path], row[path], weight[path]


def _searched(query, k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, terms, weights, docs, total = query.value
        best = _Best(len(names), k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, rows, cols, tf = (batch.column(c)[i].values for c in ("ids", "sizes", "rows", "cols", "tf"))
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                ids, sizes, rows, cols, tf = (x.to_numpy(zero_copy_only=False) for x in (ids.fill_null(NO_ID), sizes, rows, cols, tf))
                if not len(rows):
                    continue
                used, row = np.unique(rows, return_inverse=True)
                treap = Treap(row.astype(np.int64), cols.astype(np.int64), impacts(tf, sizes[cols], docs, total))
                at = np.minimum(np.searchsorted(used, terms), len(used) - 1)
                here = used[at] == terms
                counts = np.concatenate(([0], np.cumsum(here)))[first]
                at, w = at[here], weights[here]
                for j in range(0, len(names), ITEMS_AT_ONCE):
                    some = np.arange(j, min(j + ITEMS_AT_ONCE, len(names)))
                    own = counts[j : j + len(some) + 1]
                    _search(treap, some, own - own[0], at[own[0] : own[-1]], w[own[0] : own[-1]], best, ids, nulls)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), names.take(pa.array(best.item)), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item", "item_id", "doc_id", "score"])

    return of


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _round(docs: DataFrame, found: list, kind: str, k: int) -> DataFrame:
    """The k best documents of each of some items; found: their ids and terms."""
    context = docs.sparkSession.sparkContext
    known, term = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in found] or [np.empty(0, np.int64)]).view(tk.U), return_inverse=True)
    shards = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shards(context.broadcast(known)), SHARDS))
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in shards.select("rows").mapInArrow(_frequencies(len(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = np.array([term_weight(n, df.get(i, 0)) for i in range(len(known))], np.int64)
    first, terms, weights = [0], [], []
    for i, size in zip(np.cumsum([len(r["terms"]) for r in found]), (len(r["terms"]) for r in found), strict=True):
        own, count = np.unique(term[i - size : i], return_counts=True)
        terms.append(own)
        weights.append(count * weight[own])
        first.append(first[-1] + len(own))
    names = pa.array([r["item_id"] for r in found], {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.string()))
    none = np.empty(0, np.int64)
    query = context.broadcast((names, np.array(first), np.concatenate([none, *terms]), np.concatenate([none, *weights]), n, total))
    best = shards.select("ids", "sizes", "rows", "cols", "tf").mapInArrow(_searched(query, k), f"item long, item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item (item_id, text) the k best of docs (doc_id long, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = written(item_terms(items))
    n = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    rounds = max(1, -(-n // most_terms))
    out = None
    for i in range(rounds):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(rounds)) == i).collect()
        got = _round(docs, sorted(own, key=lambda r: (r["item_id"] is None, r["item_id"] if r["item_id"] is not None else 0, r["terms"])), kind, k)
        out = got if out is None else out.union(got)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return ranked(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, term, count(*) AS m FROM (SELECT i, unnest(t) AS term FROM i) GROUP BY i, term),
m AS (SELECT r, doc_id, 75 + (25 * len(t) * n) // l AS m FROM d, s),
x AS (SELECT i, r, CAST(sum(q.m * w * ((1000000000 * tf) // (1000 * tf + 12 * m.m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (i) WHERE rank <= 20"""
