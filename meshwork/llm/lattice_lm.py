"""LM scoring: the marginal likelihood of a text under a subword unigram lattice.

The pieces are those of an existing public vocabulary (a SentencePiece model file, never trained here).  A text is a row of words,
each with a space before it, and one end.  Pieces don't cross words, so the sum over all segmentations of a text is the product of
the sums over its words' segmentations: each distinct word's is found once, by a forward recursion in log space over
the lattice of its pieces, and joined with the documents.

Learning: pieces start with the vocabulary's own scores (ranks, as Zipf weights), and get expected counts from
forward-backward over the distinct words of the training documents, in rounds of EM until the words' likelihood settles
(a round gains less than TOLERANCE of it); a word's first piece, its further pieces and its stopping are separate choices, so that
the words' probabilities sum to one.  Every piece, each single byte among them, gets 0.1 more, so that any word has a probability.
A word of the training documents also is an edge of its own lattice, with its share of their tokens; what that leaves for new
words is the share of words seen once (Good-Turing).

A document belongs to one of a few classes, which nothing tells: the column `by` (its language) of the training documents does, and
their shares and word counts are learnt by class.  A text's probability is the sum over classes.  The most_classes classes
with most training documents are told apart, the others (and null) are one more.  Within a class, 2 % of a word's share are its share in all.

What is learnt, word counts, is spread over the cluster and grows with the corpus; only the pieces' sums (as many as the
vocabulary has) and at most `most_frequent` words with their scores are sent to all tasks: those above a count, which a
histogram of counts gives.  The other words of each document are joined.

Defined results: a null text is an empty one: only its end is scored; a null doc_id is taken as empty text (and is held
out); rows that repeat a doc_id and its text get equal results; words of equal counts
are frequent together or not at all; an empty table has no rows; further columns but lang aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import drop, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_FREQUENT, TOLERANCE, EXTRA, OWN = 1 << 17, 0.004, 0.1, 0.98
LONG = 512


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary's pieces as bytes (a space for the mark of a word's begin), each once, and their first weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([i]): 0.0 for i in range(256)}
    n = model.get_piece_size()
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            name, rank = bytes([int(piece[1:-1], 16)]), n
        else:
            name, rank = piece.replace("▁", " ").encode(), min(-model.get_score(i), n)
        if b" " not in name[1:]:
            weight[name] = weight.get(name, 0.0) + 1 / (rank + 2.7)
    return list(weight), np.array([w or 1 / (n + 2.7) for w in weight.values()])


class Lattice:
    """The segmentations of words into pieces, for many words at a time."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        """logs: the pieces' natural log probabilities."""
        keys = self._keys(pieces)
        order = np.argsort(keys)
        self.keys, self.piece, self.logs = keys[order], order, logs
        self.longest = max(map(len, pieces))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> tk.U(44)).astype(np.int64)] = True

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        up, _ = tk.powers(tk._STEP, codes.shape[-1] + 1)
        out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), tk.U)
        np.cumsum(tk._byte_values(3, False)[codes] * up[: codes.shape[-1]], axis=-1, out=out[..., 1:])
        return out

    @staticmethod
    def _of_size(n: int) -> np.uint64:
        return tk.U(n * tk._WORD_STEP & (2**64 - 1))

    def _keys(self, pieces: list[bytes]) -> np.ndarray:
        return np.concatenate([self._sums(np.frombuffer(p, np.uint8))[-1:] + self._of_size(len(p)) for p in pieces])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.seen[(keys >> tk.U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        return maybe[hit], self.piece[at[hit]]

    def edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end, the pieces that end there: their lengths, the words (rows of codes) and the pieces."""
        sums = self._sums(codes)
        n = codes.shape[1]
        _, down = tk.powers(tk._STEP, n + 1)
        return [[(size, *self._find((sums[:, end] - sums[:, end - size]) * down[end - size] + self._of_size(size))) for size in range(1, min(end, self.longest) + 1)] for end in range(1, n + 1)]

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        """The log probability of each word's first 0, 1, ... bytes, over all their segmentations."""
        out = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        out[:, 0] = 0
        for end, ways in enumerate(edges, 1):
            for size, word, piece in ways:
                out[word, end] = np.logaddexp(out[word, end], out[word, end - size] + self.logs[piece])
        return out

    def counted(self, codes: np.ndarray, total: np.ndarray) -> float:
        """Adds the pieces' expected counts over all segmentations of each word; the sum of their log probabilities."""
        edges = self.edges(codes)
        forward = self.forward(codes, edges)
        n = codes.shape[1]
        back = np.full(forward.shape, -np.inf)
        back[:, n] = 0
        for end in range(n, 0, -1):
            for size, word, piece in edges[end - 1]:
                through = back[word, end] + self.logs[piece]
                back[word, end - size] = np.logaddexp(back[word, end - size], through)
                np.add.at(total, piece, np.exp(forward[word, end - size] + through - forward[word, n]))
        return float(forward[:, n].sum())

    def _ways(self, word: bytes) -> list[list[tuple[int, int, float]]]:
        """Of one long word, for each end, the pieces that end there: where they begin, which and their logs."""
        sums, n = self._sums(np.frombuffer(word, np.uint8)), len(word)
        _, down = tk.powers(tk._STEP, n + 1)
        ways: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for size in range(1, min(self.longest, n) + 1):
            begin, piece = self._find((sums[size:] - sums[:-size]) * down[: n - size + 1] + self._of_size(size))
            for b, p, log in zip(begin.tolist(), piece.tolist(), self.logs[piece].tolist(), strict=True):
                ways[b + size].append((b, p, log))
        return ways

    def long_score(self, word: bytes, ways: list | None = None) -> np.ndarray:
        """forward() of one long word: its pieces are found for all ends at once."""
        ways = ways or self._ways(word)
        out = np.full(len(word) + 1, -np.inf)
        out[0] = 0
        for end in range(1, len(word) + 1):
            out[end] = np.logaddexp.reduce([out[b] + log for b, _, log in ways[end]])
        return out

    def long_counted(self, word: bytes, total: np.ndarray) -> float:
        """counted() of one long word, once; its log probability."""
        ways = self._ways(word)
        forward, back = self.long_score(word, ways), np.full(len(word) + 1, -np.inf)
        back[-1] = 0
        for end in range(len(word), 0, -1):
            for b, p, log in ways[end]:
                back[b] = np.logaddexp(back[b], back[end] + log)
                total[p] += math.exp(forward[b] + back[end] + log - forward[-1])
        return float(forward[-1])


def _groups(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time, a space before each: which, and their bytes as rows."""
    raw, at = tk.flat(pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar("")))
    size = np.diff(at)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        step = len(which) if n <= LONG else 1
        for i in range(0, len(which), step):
            part = which[i : i + step]
            yield part, raw[at[part][:, None] + np.arange(n)]


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (class, text) to (class, h, word, c); class -1 is held out, and counts 0."""
    for batch in batches:
        for part in tk.chunks(batch):
            words = tk.Words(part.column("text"))
            of = np.repeat(part.column("class").to_numpy().astype(np.int64), words.counts())
            h, at, back = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
            text = pa.array([words.bytes(i).lower().decode("utf-8", "replace") for i in at.tolist()], pa.string())
            both, n = np.unique(back * 64 + of + 1, return_counts=True)
            which, c = both // 64, both % 64 - 1
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), tk.signed(h[which]), text.take(pa.array(which)), pa.array(np.where(c < 0, 0, n))], ["class", "h", "word", "c"])


def _expected(lattice):
    """For mapInArrow: words to the pieces' expected counts, and the words' log probability as piece -1."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, log = np.zeros(len(lattice.value.logs)), 0.0
        for batch in _together(batches):
            for _, codes in _groups(batch.column("word")):
                log += lattice.value.counted(codes, total) if codes.shape[1] <= LONG else sum(lattice.value.long_counted(x.tobytes(), total) for x in codes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], log))], ["piece", "m"])

    return of


def _logs(pieces: list[bytes], weight: np.ndarray, words: int) -> tuple[np.ndarray, float]:
    """The pieces' log probabilities and the stop's, of their expected counts in so many words."""
    first = np.array([p[:1] == b" " for p in pieces])
    stop = (words + EXTRA) / (weight.sum() + 2 * EXTRA)
    stop = min(max(stop, 1e-3), 1 - 1e-3)
    return np.where(first, np.log(weight / weight[first].sum()), np.log(weight / weight[~first].sum()) + np.log(1 - stop)), float(np.log(stop))


def _scored(lattice, stop: float, new: float, v: int, sizes: list[int]):
    """For mapInArrow: (h, word, c0, c1, ...) to (h, c, base, s0, s1, ...): logs of the word's probability by class. sizes: the classes' tokens."""
    n, classes = sum(sizes), range(len(sizes))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            each = [batch.column(f"c{k}").to_numpy() for k in classes]
            c = sum(each, np.zeros(batch.num_rows, np.int64))
            score = np.zeros(len(c))
            for which, codes in _groups(batch.column("word")):
                if codes.shape[1] <= LONG:
                    score[which] = lattice.value.forward(codes, lattice.value.edges(codes))[:, -1]
                else:
                    score[which] = [lattice.value.long_score(x.tobytes())[-1] for x in codes]
            tail = new * np.exp(np.maximum(score + stop, -700))
            less = np.where(c > 0, 0, np.minimum(score + stop + 700, 0) / np.log(10))
            logs = [np.log10((1 - new) * (OWN * each[k] / max(sizes[k], 1) + (1 - OWN) * c / max(n, 1)) + tail) + less for k in classes]
            names = ["h", "c", "base", *[f"s{k}" for k in classes]]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(c), pa.array(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))), *map(pa.array, logs)], names)

    return of


def _split(top):
    """Each word's place among the frequent words (or where it would be), and whether it is one."""
    keys = top.value[0]

    def of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    return of


def _frequent(top, names: list[str]):
    """For mapInArrow: (doc_id, key, held_out, text) to its sums over frequent words of top's columns, and the number of other words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, (_, *columns) = _split(top), top.value
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(part.column("text"))
                at, own = split(words.hashes(lower=True))
                sums = [tk.segment_sums(np.where(own, x[at], 0) if len(x) else np.zeros(len(at)), words.first) for x in columns]
                rare = tk.segment_sums((~own).astype(np.int64), words.first)
                out = [words.counts() + 1, rare, sums[0].astype(np.int64), *sums[1:]]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "key", "held_out")] + [pa.array(x) for x in out], ["doc_id", "key", "held_out", "n_tokens", "rare", "n_known", *names])

    return of


def _rare(top):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _split(top)
        for batch in batches:
            for part in tk.chunks(batch):
                words = tk.Words(part.column("text"))
                h = words.hashes(lower=True)
                mine = ~split(h)[1]
                h, row = h[mine], words.rows()[mine]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
                row = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("key").take(row), tk.signed(h[first]), pa.array(np.diff(first, append=len(h)).astype(np.int32))], ["doc_id", "key", "h", "m"])

    return of


def _classes(rows: DataFrame, most: int) -> tuple[Column, list[int]]:
    """Of rows (held_out, group), each one's class as a number, and the classes' training documents. The last is that of all other groups."""
    if most < 1:
        return F.lit(0), [rows.where("not held_out").count()]
    counts = rows.where("not held_out").groupBy("group").agg(F.count("*").alias("n"))
    first = counts.where("group is not null").orderBy(F.desc("n"), "group").limit(most).collect()
    out = F.lit(len(first))
    for k, r in enumerate(first):
        out = F.when(F.col("group") == r["group"], k).otherwise(out)
    return out, [*[r["n"] for r in first], (counts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in first)]


def _above(table: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach; from a histogram in steps of a sixteenth, of a few hundred rows."""
    step = F.floor(F.log2("c") * 16).cast("int")
    total, above = 0, 1 << 62
    for r in table.where("c > 0").groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():
        total += r["n"]
        if total > most:
            return above
        above = r["c"]
    return 1


def scored_texts(docs: DataFrame, vocabulary: str = VOCABULARY, most_frequent: int = MOST_FREQUENT, by: str | None = "lang", most_classes: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text, and `by` if it is there)."""
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    group = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), (F.crc32(id_text) % 10 == 0).alias("held_out"), group.alias("group"), "text")
    of, members = _classes(rows.select("held_out", "group"), most_classes if by in docs.columns else 0)
    classes = range(len(members))
    counted = rows.select(F.when(F.col("held_out"), -1).otherwise(of).alias("class"), "text").mapInArrow(_counting, "class int, h long, word string, c long")
    each = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in classes]
    words = written(counted.groupBy("h", "word").agg(*each, F.sum("c").alias("c")))
    seen = words.where("c > 0")
    sizes = seen.agg(F.count("*"), F.count_if(F.col("c") == 1), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in classes]).first()
    v_words, once, ends = sizes[0], sizes[1], sum(members)
    sizes = [a + b for a, b in zip(sizes[2:], members, strict=True)]
    n, v = sum(sizes), v_words + (ends > 0)

    # some chance for new words, and for known ones
    new = min(max(once / max(n, 1), 1 / (n + 2)), (n + 1) / (n + 2)) if n else 1.0
    pieces, weight = pieces_of(vocabulary)
    logs, stop = _logs(pieces, weight, 0.5 * weight.sum())
    before = -np.inf
    while v_words:
        shared = context.broadcast(Lattice(pieces, logs))
        got = {r["piece"]: r["m"] for r in seen.mapInArrow(_expected(shared), "piece int, m double").groupBy("piece").agg(F.sum("m").alias("m")).collect()}
        now = got.pop(-1) + v_words * stop
        weight = np.full(len(pieces), EXTRA)
        weight[list(got)] += list(got.values())
        logs, stop = _logs(pieces, weight, v_words)
        shared.destroy()
        if now - before < -TOLERANCE * now:
            break
        before = now
    shared = context.broadcast(Lattice(pieces, logs))

    scores = [f"s{k}" for k in classes]
    names = ["base", *scores]
    scored = words.select("h", "word", *[f"c{k}" for k in classes]).mapInArrow(_scored(shared, stop, new, v, sizes), "h long, c long, " + ", ".join(f"{c} double" for c in names))
    table = written(scored)
    drop(words)
    frequent = table.where(F.col("c") >= _above(table, most_frequent)).toArrow()
    frequent = frequent.take(pa.array(np.argsort(frequent["h"].to_numpy().view(tk.U))))
    top = context.broadcast((frequent["h"].to_numpy().view(tk.U), (frequent["c"].to_numpy() > 0).astype(float), *(frequent[c].to_numpy() for c in names)))

    mine = rows.drop("group").mapInArrow(_frequent(top, names), f"doc_id {kind}, key long, held_out boolean, n_tokens long, rare long, n_known long, " + ", ".join(f"{c} double" for c in names))
    rest = rows.select("doc_id", "key", "text").mapInArrow(_rare(top), f"doc_id {kind}, key long, h long, m int").join(table, "h")
    rest = rest.groupBy("doc_id", "key").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("n_known"), *[F.sum(F.col("m") * F.col(c)).alias(c) for c in names])
    both = mine.alias("x").join(rest.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.key") == F.col("y.key")), "left")
    share = F.coalesce(F.col("x.rare") / F.col("y.m"), F.lit(0.0))  # repeated rows are joined once
    add = lambda c: F.col(f"x.{c}") + F.coalesce(share * F.col(f"y.{c}"), F.lit(0.0))
    of_end = lambda k: (1 - new) * (OWN * members[k] / max(sizes[k], 1) + (1 - OWN) * ends / n) if ends else 0.5
    by_class = F.array(*[add(f"s{k}") + float(np.log10(of_end(k) * (members[k] / ends if ends else 1))) for k in classes if members[k] or not ends])
    highest = F.array_max("all")
    score = highest + F.log10(F.aggregate(F.transform("all", lambda x: F.pow(F.lit(10.0), x - highest)), F.lit(0.0), lambda a, x: a + x))
    base = add("base") + float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))
    out = both.select("x.doc_id", "x.held_out", "x.n_tokens", F.round(add("n_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), by_class.alias("all"))
    return out.withColumn("score", score).drop("all")


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the lattice, learnt from nine tenths of them."""
    return scored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
