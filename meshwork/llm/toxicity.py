"""Toxicity: a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

The kernel of two strings counts the subsequences of 3 and 4 characters that they share, within spans of SPAN characters, each gap
weighted by DECAY, and is normalised.  A character between those of an insult, or a mark or space between its letters, widens
spans but leaves subsequences, so gapped and altered insults stay near the plain ones.  The strings are the words of
sentences: a word's letters and digits, lower-cased, with gaps for other characters between them; the parts between those; and runs of
single characters (as in "i d i o t").  A sentence's margin is that of its highest word; a document's score is a logistic function of the margins of
its TOP highest distinct words, as one word that looks like an insult says less than three.

A landmark is a word of the sample; a word's Nystroem features are its kernels with all landmarks, in the metric of the
landmarks' own kernels.  Half of the landmarks are those that tell toxic documents best, the others are drawn by hash.  On these features a linear
machine with squared hinge loss is fitted by Newton steps: tasks sum the loss's second moments over their words, the driver solves one
system of LANDMARKS + 1 unknowns.  As the kernel is a sum over subsequences, the fitted machine is a weight for each of the landmarks'
subsequences, which tasks look up.

Labels mark documents.  All sentences of clean documents are clean.  A toxic document's sentences are labelled by their witnesses: the words that
occur in toxic documents so much more often than in clean ones that, of all words, none would by chance (by the likelihood ratio).  Without any
such words, each document's most telling word is its first witness, and in turn with fitting the one of highest margin, if that is above 0.
Witnesses also count with a gap at each place and between all letters.
A quarter of the labelled documents is left out of this and gives the logistic function, which no margin lowers; classes weigh what they do among all labels.

Bounds, of the labelled sample only: MOST_TOXIC and MOST_CLEAN documents, by hash; every text is scored whole.

Defined results: a null or empty text has no words, and the margin that a word without subsequences has; without labels of both classes all scores are 0;
null labels and null doc_ids teach nothing; of labels that repeat a doc_id the greatest counts, of documents that do, the least text teaches;
each row of documents has its own score; further columns are ignored, whatever their names; words of equal margin: the first.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import drop, written

SPAN, DECAY, WINDOW, GAP, BEGIN, CLOSE = 5, 0.6, 32, "\0", "\1", "\2"
LANDMARKS, MOST_TOXIC, MOST_CLEAN = 320, 2000, 2000
ROUNDS, STEPS, RIDGE, SHARE, TOP = 3, 6, 0.3, 0.3, 3
CHUNK, MOST_KNOWN, MOST_WITNESSES = 1 << 21, 1 << 20, 4000
MARK = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])
PARTS = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?\n]")
_MULTIPLIERS = [tk.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Where the characters of a subsequence are, from its first one on
PLACES = [(0, *more) for k in (2, 3) for more in itertools.combinations(range(1, SPAN), k)]


def units(word: str) -> list[str]:
    """The strings of a word, between marks of their ends: its letters and digits with gaps, and its parts if there are several; in windows where
    long.  What has fewer than three letters is no string."""
    word = word.lower()
    parts = PARTS.findall(word)
    if len(parts) > 1:
        parts = [re.sub(r"[\W_]", GAP, word).strip(GAP), *parts]
    return [x for p in parts if len(p) > 2 for x in windows(p)]


def windows(part: str) -> list[str]:
    whole = BEGIN + part + CLOSE
    return [whole] if len(whole) <= WINDOW else [whole[i : i + WINDOW] for i in range(0, len(whole) - WINDOW // 2, WINDOW // 2)]


@dataclass
class Subsequences:
    """Of some strings, which subsequences (by hash) each has, in order, and their share: unit vectors."""

    row: np.ndarray
    key: np.ndarray
    share: np.ndarray
    n: int

    @classmethod
    def of(cls, strings: list[str]) -> Subsequences:
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), np.uint32)
        first = np.cumsum(size) - size
        found = []
        for low, high in ((3, 6), (7, 8), (9, 10), (11, 12), (13, 16), (17, 24), (25, WINDOW)):
            rows = np.flatnonzero((size >= low) & (size <= high))
            for at in range(0, len(rows), 1 << 14):
                found.append(cls._of_size(codes, first, size, rows[at : at + (1 << 14)], high))
        row, key, share = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, tk.U), np.empty(0))
        return cls(row, key, share, len(strings))

    @staticmethod
    def _of_size(codes: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.arange(width) < size[rows][:, None]
        chars = np.zeros((len(rows), width + SPAN), tk.U)
        chars[:, :width][inside] = codes[(first[rows][:, None] + np.arange(width))[inside]]
        real = chars != 0
        products = [chars * m for m in _MULTIPLIERS]
        keys = []
        for places in PLACES:
            h = sum(products[i][:, p : p + width] for i, p in enumerate(places)) + tk.U(len(places) << 58)
            ok = real[:, :width]
            for p in places[1:]:
                ok = ok & real[:, p : p + width]
            gaps = places[-1] + 1 - len(places)
            keys.append(np.where(ok, h & ~tk.U(3) | tk.U(gaps), ~tk.U(0)))
        key = np.concatenate(keys, 1)
        key.sort(1)
        some = key != ~tk.U(0)
        of, flat = np.repeat(np.arange(len(rows)), some.sum(1)), key[some]
        weight = (DECAY ** np.arange(4))[(flat & tk.U(3)).astype(np.int64)]
        flat >>= tk.U(2)
        at = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (of[1:] != of[:-1]))) if len(flat) else np.empty(0, bool))
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, tk.U), np.empty(0)
        weight, of, flat = np.add.reduceat(weight, at), of[at], flat[at]
        norm = np.sqrt(np.bincount(of, weight * weight, len(rows)))
        return rows[of], flat, weight / norm[of]


class Table:
    """Sorted subsequences; those of others are looked up in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(keys >> tk.U(44)).astype(np.int64)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of key are there, and where."""
        maybe = np.flatnonzero(self.seen[(key >> tk.U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == key[maybe]
        return maybe[ok], at[ok]


class Landmarks:
    """Landmark strings, and the kernel of others with them."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        own = Subsequences.of(strings)
        order = np.lexsort((own.row, own.key))
        self.landmark, self.share = own.row[order], own.share[order]
        keys, at = np.unique(own.key[order], return_index=True)
        self.table, self.first = Table(keys), np.append(at, len(order))
        self.own = self.kernel(strings)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """A row for each string, a column for each landmark."""
        m, out = len(self.strings), np.zeros(len(strings) * len(self.strings))
        s = Subsequences.of(strings)
        i, at = self.table.find(s.key) if m else (np.empty(0, np.int64),) * 2
        for part in np.array_split(np.arange(len(i)), 1 + len(i) // (1 << 20)):
            n = self.first[at[part] + 1] - self.first[at[part]]
            j = np.arange(n.sum()) + np.repeat(self.first[at[part]] - (np.cumsum(n) - n), n)
            k = np.repeat(i[part], n)
            out += np.bincount(s.row[k] * m + self.landmark[j], s.share[k] * self.share[j], len(out))
        return out.reshape(len(strings), m)

    def features(self, strings: list[str]) -> np.ndarray:
        return np.hstack([self.kernel(strings), np.ones((len(strings), 1))])

    def machine(self, w: np.ndarray) -> Machine:
        """The weights w of features as weights of subsequences."""
        each = w[:-1][self.landmark] * self.share
        return Machine(self.table, np.add.reduceat(each, self.first[:-1]) if len(each) else each, float(w[-1]), np.zeros(TOP + 1))


@dataclass
class Machine:
    """A fitted machine: weights of subsequences, the margin of strings that have none, and the logistic curve on TOP margins."""

    table: Table
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, strings: list[str]) -> np.ndarray:
        s = Subsequences.of(strings)
        if not len(self.table.keys):
            return np.full(len(strings), self.bias)
        i, at = self.table.find(s.key)
        return self.bias + np.bincount(s.row[i], s.share[i] * self.weights[at], len(strings))

    def scores(self, tops: np.ndarray) -> np.ndarray:
        z = tops @ self.curve[:-1] + self.curve[-1]
        return np.where(z < -700, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))

    def tops(self, margin: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, int]:
        """The TOP highest margins of different strings of one document, as many as there are, and where the highest is."""
        out = np.full(TOP, self.bias)
        order, seen = np.argsort(-margin, kind="stable"), []
        for i in order.tolist():
            if string[i] not in seen:
                out[len(seen)] = margin[i]
                seen.append(string[i])
                if len(seen) == TOP:
                    break
        return out, int(order[0])


def _is_single(words: tk.Words) -> np.ndarray:
    lead = words.raw[words.begin]
    return (words.end - words.begin) == np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _spelt(words: tk.Words) -> tuple[list[str], list[int]]:
    """Runs of three single characters or more, in windows, and the first word of each."""
    single = np.concatenate(([False], _is_single(words), [False])) if len(words.begin) else np.zeros(2, bool)
    row = words.rows()
    begin, end = np.flatnonzero(single[1:] & ~single[:-1]), np.flatnonzero(single[:-1] & ~single[1:])
    out, at = [], []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if b - a < 3:
            continue
        cuts = [a, *(c for c in range(a + 1, b) if row[c] != row[c - 1]), b]
        for x, y in itertools.pairwise(cuts):
            if y - x < 3:
                continue
            letters = words.raw[words.begin[x] : words.end[y - 1]].tobytes().decode(errors="replace").split()
            for i in range(0, max(y - x - WINDOW // 4, 1), WINDOW // 4):
                text = GAP.join(c if c.isalnum() else GAP for c in letters[i : i + WINDOW // 2 - 1]).lower().strip(GAP)
                out.append((BEGIN + text + CLOSE)[:WINDOW])
                at.append(x + i)
    return out, at


def _trimmed(words: tk.Words) -> tk.Words:
    """The words without ASCII marks around them, so that fewer differ."""
    for _ in range(4):
        long = words.end - words.begin > 1
        words.end = words.end - (long & MARK[words.raw[words.end - 1]])
        long = words.end - words.begin > 1
        words.begin = words.begin + (long & MARK[words.raw[words.begin]])
    return words


class Margins:
    """The margins of words; up to MOST_KNOWN distinct ones are remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.known, self.margin = machine, np.empty(0, tk.U), np.empty(0)

    def of(self, text: pa.Array) -> tuple[tk.Words, np.ndarray, np.ndarray]:
        """A text column's words, their margins (those of runs of single characters at their first word), and numbers that tell words apart."""
        words = tk.Words(text)
        spelt, at = _spelt(words)
        words = _trimmed(words)
        h, some, which = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        each = np.empty(len(h))
        place = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[place] == h if len(self.known) else np.zeros(len(h), bool)
        each[old] = self.margin[place[old]]
        new = np.flatnonzero(~old)
        lists = [units(words.bytes(i).decode(errors="replace")) for i in some[new].tolist()]
        margin = self.machine.margins([u for x in lists for u in x] + spelt)
        own = np.full(len(new), self.machine.bias)
        np.maximum.at(own, np.repeat(np.arange(len(new)), [len(x) for x in lists]), margin[: len(margin) - len(spelt)])
        each[new] = own
        if len(self.known) + len(new) <= MOST_KNOWN:
            order = np.argsort(both := np.concatenate((self.known, h[new])))
            self.known, self.margin = both[order], np.concatenate((self.margin, own))[order]
        out = each[which]
        np.maximum.at(out, np.array(at, np.int64), margin[len(margin) - len(spelt) :])
        return words, out, which


def _scored(machine):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        margins = Margins(m)
        for batch in batches:
            for part in tk.chunks(batch, most=CHUNK):
                words, margin, which = margins.of(part.column("text"))
                top, sentence = np.full((part.num_rows, TOP), m.bias), [None] * part.num_rows
                for i, (a, b) in enumerate(itertools.pairwise(words.first.tolist())):
                    if a < b:
                        top[i], j = m.tops(margin[a:b], which[a:b])
                        j += a
                        # as bytes: the marks that end sentences are single ones
                        before = words.raw[words.at[i] : words.begin[j]].tobytes()
                        after = words.raw[words.begin[j] : words.at[i + 1]].tobytes()
                        x = 1 + max(before.rfind(c) for c in (b".", b"!", b"?", b"\n"))
                        y = min((k + 1 for c in (b".", b"!", b"?", b"\n") if (k := after.find(c)) >= 0), default=len(after))
                        sentence[i] = (before[x:] + after[:y]).decode(errors="replace").strip()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(top[:, 0]), pa.array(m.scores(top)), pa.array(sentence, pa.string())], ["doc_id", "margin", "score", "sentence"])

    return of


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch):
            lists = []
            for text in part.column("text"):
                words = tk.Words(pa.array([text.as_py()], pa.string()))
                lists.append(sorted({u for w in words.raw.tobytes().split() for u in units(w.decode())} | {*_spelt(words)[0]}))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("apart"), pa.array(lists, pa.list_(pa.string()))], ["toxic", "apart", "strings"])


def known_labels(labels: DataFrame, taught: Column) -> DataFrame:
    """(doc_id, toxic) of the labels to learn from; taught: of doc_id, which may teach."""
    return labels.where(F.col("doc_id").isNotNull() & taught & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sampled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of labelled documents: at most MOST_TOXIC and MOST_CLEAN by hash."""
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    found = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _top(machine):
    """Of each bag its string of highest margin, and its TOP margins."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            strings, at = batch.column("strings").flatten().to_pylist(), np.cumsum([0, *(len(x) for x in batch.column("strings"))])
            margin, number = m.margins(strings), np.arange(len(strings))
            tops = [m.tops(margin[a:b], number[a:b]) if a < b else (np.full(TOP, m.bias), -1) for a, b in itertools.pairwise(at.tolist())]
            best = [strings[a + j] if j >= 0 else None for a, (_, j) in zip(at.tolist(), tops, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(best, pa.string()), pa.array([t.tolist() for t, _ in tops], pa.list_(pa.float64()))], ["toxic", "string", "margins"])

    return of


TOPS = "toxic int, string string, margins array<double>"


def _telling(known):
    """Of each bag the string that tells most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [max((x for x in s if x in known.value), key=lambda x: (known.value[x], x), default=None) for s in batch.column("strings").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string())], ["string"])

    return of


def variants(string: str) -> list[str]:
    """The string with a gap at each place, and between all of its letters."""
    return [string[:i] + GAP + string[i:] for i in range(2, len(string) - 1)] + [string[0] + GAP.join(string[1:-1]) + string[-1]]


def _moments(landmarks, w: np.ndarray):
    """Over a task's clean strings: second moments and sums of those on the wrong side of the margin, as one binary row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(w)
        total, n = np.zeros((m, m + 1)), 0
        for batch in batches:
            strings = batch.column("string").to_pylist()
            for i in range(0, len(strings), 1 << 13):
                x = landmarks.value.features(strings[i : i + (1 << 13)])
                n += len(x)
                x = x[x @ w > -1]
                total += x.T @ np.hstack([x, -np.ones((len(x), 1))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n])], ["total", "n"])

    return of


def fit_curve(margins: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Slopes (0 at least) and intercept of the logistic function, by Newton steps; targets are drawn in a little, so that classes that don't overlap
    have one too."""
    weight = np.ones(len(toxic)) if weight is None else weight
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    full, some = np.column_stack([margins, np.ones(len(margins))]), np.ones(margins.shape[1] + 1, bool)
    while True:
        x, beta = full[:, some], np.zeros(some.sum())
        loss = lambda b: float((weight * (np.logaddexp(0, x @ b) - target * (x @ b))).sum() + 1e-3 * b @ b)  # noqa: B023, E731
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ beta)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(len(beta)), x.T @ (weight * (target - p)) - 2e-3 * beta)
            size = 1.0
            while loss(beta + size * step) > loss(beta) and size > 1e-6:
                size /= 2
            beta = beta + size * step
            if np.abs(size * step).max() < 1e-8:
                break
        out = np.zeros(len(some))
        out[some] = beta
        if (out[:-1] >= 0).all():
            return out
        some[:-1] &= out[:-1] > 0


def fit(docs: DataFrame, labels: DataFrame, taught: Column, landmarks: int = LANDMARKS) -> Machine:
    """A machine from docs (doc_id, text) and labels (doc_id, toxic)."""
    context = docs.sparkSession.sparkContext
    none = Machine(Table(np.empty(0, tk.U)), np.empty(0), -1.0, np.append(np.zeros(TOP), -800.0))
    known = known_labels(labels, taught)
    rows = sampled(docs, known).select("toxic", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)) == 0).alias("apart"), "text")
    bags = written(rows.repartition(8).mapInArrow(_bags, "toxic int, apart boolean, strings array<string>"))
    counts = {(r["toxic"], r["apart"]): r["count"] for r in bags.groupBy("toxic", "apart").count().collect()}
    if not all(counts.get((t, False)) for t in (0, 1)):
        return none
    learn = bags.where("not apart")
    toxic, clean = (counts[t, False] for t in (1, 0))
    words = learn.select("toxic", F.explode("strings").alias("string")).groupBy("string").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    p, share = toxic / (toxic + clean), F.col("a") / (F.col("a") + F.col("b"))
    ratio = F.col("a") * F.log(share / p) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - p))).otherwise(0.0)
    words = written(words.withColumn("ratio", F.when(share > p, ratio).otherwise(0.0)))
    telling = words.where("a > 1 and ratio > 0").orderBy(F.desc("ratio"), "string").limit(MOST_WITNESSES).collect()
    drawn = words.where("b > 0").orderBy(F.xxhash64("string"), "string").limit(landmarks - min(len(telling), landmarks // 2)).select("string").collect()
    if not telling:
        return none
    least = np.log(words.count())
    sure = [r for r in telling if r["ratio"] > least]
    telling = telling[: landmarks // 2]
    strings = sorted({r["string"] for r in (*telling, *drawn)})
    marks = Landmarks(strings)
    sent = context.broadcast(marks)
    ridge = np.pad(RIDGE * (marks.own + 1e-6 * np.eye(len(strings))), (0, 1))
    ridge[-1, -1] = 1e-6
    clean_words = written(words.where("b > 0").select("string").repartition(8))
    fixed = {r["string"]: float(r["a"]) ** 0.5 for r in sure}
    witnesses = None if sure else learn.where("toxic = 1").mapInArrow(_telling(context.broadcast({r["string"]: r["ratio"] for r in telling})), "string string")
    w = np.zeros(len(strings) + 1)
    w[-1] = -1
    for _ in range(1 if sure else ROUNDS):
        found = witnesses.where("string is not null").groupBy("string").agg(F.sqrt(F.count("*")).alias("n")).collect() if witnesses else []
        each = {r["string"]: r["n"] for r in found} | fixed
        if not each:
            break
        listed = [(s, n / 2) for s, n in sorted(each.items())]
        listed += [(v, n / len(more)) for s, n in listed for more in [variants(s)] for v in more]
        x, each = marks.features([s for s, _ in listed]), np.array([n for _, n in listed])
        for _ in range(STEPS):
            parts = clean_words.mapInArrow(_moments(sent, w), "total binary, n long").collect()
            total = sum(np.frombuffer(r["total"]).reshape(len(w), -1) for r in parts)
            near = x @ w < 1
            y = x[near] * (SHARE * sum(r["n"] for r in parts) / each.sum() * each[near])[:, None]
            new = np.linalg.solve(total[:, :-1] + y.T @ x[near] + ridge, total[:, -1] + y.sum(0))
            moved, w = np.abs(x @ (new - w)).max(), new
            if moved < 1e-2:
                break
        machine = context.broadcast(marks.machine(w))
        witnesses = learn.where("toxic = 1").mapInArrow(_top(machine), TOPS).where("margins[0] > 0").select("string")
    machine = marks.machine(w)
    apart = bags.where("apart") if all(counts.get((t, True)) for t in (0, 1)) else bags
    seen = apart.mapInArrow(_top(context.broadcast(machine)), TOPS).select("toxic", "margins").collect()
    # the classes count as they do among all labels, not as in the sample
    toxic, all_ = np.array([r["toxic"] for r in seen]), {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weight = np.where(toxic == 1, all_[1] / max((toxic == 1).sum(), 1), all_[0] / max((toxic == 0).sum(), 1))
    machine.curve = fit_curve(np.array([r["margins"] for r in seen]), toxic, weight / weight.mean())
    drop(bags, words, clean_words)
    return machine


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, margin, score and the sentence of the highest margin of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.select("doc_id", "text").mapInArrow(_scored(sent), f"doc_id {kind}, margin double, score double, sentence string")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, learnt from four fifths of the labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    found = toxicity(docs, fit(docs, labels, rest != 0))
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
