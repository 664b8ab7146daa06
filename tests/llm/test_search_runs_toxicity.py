"""Lexical search, periodic runs and toxicity against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import lexical_search, periodic_runs, toxicity
from meshwork.llm import textkit as tk

SCHEMA = "doc_id long, text string, item_id long, score double, rank int, item string, terms string, sentence string"
MORE = (1, 0.5, 1, "i", "t", "s")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *MORE) for i, t in rows], SCHEMA)


# --- lexical search


def best(docs, items, k=20):
    terms = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [terms(t) for _, t in docs]
    n, size = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for x in words for w in set(x))
    out = []
    for item, text in set(items):
        found = []
        for (i, _), x in zip(docs, words, strict=True):
            tf, m = Counter(x), 75 + 25 * len(x) * n // max(size, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def some_docs():
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    texts = [" ".join(word() for _ in range(rng.choice([1, 4, 30, 90]))) for _ in range(150)]
    texts += [texts[5]] * 40 + ["", None, " ... ", "Ünï w3, W3-w4 ABC\nw5", " ".join(word() for _ in range(260_000))]
    return [*enumerate(texts), (7, texts[7]), (7, "w1 w2"), (None, "w1 w2 w3")]


def test_search_is_exact(spark):
    docs = some_docs()
    items = [(i, docs[i][1]) for i in range(0, 190, 9)] + [(1, "w1 w1 w2 w3"), (1, "w1 w1 w2 w3"), (1, "Ünï abc"), (2, None), (3, ""), (None, "w7 w8"), (4, "nowhere")]
    # items (item_id, text) with the documents' further columns
    asked = frame(spark, [(None, None)]).limit(0).drop("item_id").unionByName(spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long"), allowMissingColumns=True)
    for most in (1 << 18, 40):
        got = lexical_search.ranked(frame(spark, docs).repartition(3), asked, most_terms=most)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == best(docs, items)
    assert lexical_search.ranked(frame(spark, docs).limit(0), asked).count() == 0
    assert lexical_search.ranked(frame(spark, docs), asked.limit(0)).count() == 0


def test_treap_has_the_cells_and_their_maxima():
    rng = np.random.default_rng(1)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(13, size=60), rng.integers(50, size=60), rng.integers(1, 99, size=60), strict=True)}
    t = lexical_search.Treap(*(np.array(x) for x in zip(*((r, c, v) for (r, c), v in cells.items()), strict=True)))
    assert t.top[0] == max(cells.values())
    for r in range(13):
        for c in range(50):
            node = 0
            for level in range(t.bits - 1, -1, -1):
                above, node = t.top[node], int(t.child(np.array([node]), np.array([2 * (r >> level & 1) + (c >> level & 1)]))[0])
                if node < 0:
                    break
                assert t.top[node] <= above
            assert (node >= 0) == ((r, c) in cells)
            if node >= 0:
                assert t.top[node] == cells[r, c]


# --- periodic runs


def runs_of(w, least=12):
    out, n = {}, len(w)
    for d in range(1, n // 2 + 1):
        i = d
        while i < n:
            j = i
            while j < n and w[j] == w[j - d]:
                j += 1
            if j > i and j - i + d >= max(least, 2 * d):
                out.setdefault((i - d, j - i + d), d)
            i = max(j, i + 1)
    return sorted(((s, n, d) for (s, n), d in out.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 7)):
            k = rng.choice([1, 2, 2, 3, 5])
            d = [rng.randrange(k) for _ in range(rng.randrange(90))]
            if rng.random() < 0.6:
                d += ([rng.randrange(k) for _ in range(rng.randrange(1, 20))] * 10)[: rng.randrange(60)] + [rng.randrange(k) for _ in range(5)]
            docs.append(d + [0, 1] * rng.randrange(20) + [1, 0] * rng.randrange(20))
        least = rng.choice([12, 12, 2, 6, 20])
        first = np.cumsum([0, *map(len, docs)])
        found = [[] for _ in docs]
        for r, *run in zip(*(c.tolist() for c in periodic_runs.periodic_runs(tk.mix(np.concatenate(docs).astype(tk.U) + tk.U(1)), first, least)), strict=True):
            found[r].append(tuple(run))
        assert found == [runs_of(d, least) for d in docs]


def test_runs_of_documents(spark):
    rng = random.Random(2)
    block = lambda n: [rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(n)]
    texts = ["\t".join(block(20) + block(15) * 3 + block(9)) for _ in range(20)] + ["same " * 90_000, " ".join(block(150_000)), "x y " * 6, "x y " * 5, "", " \n", None, "Ä b\x0bc " * 12, "y" * 3000]
    rows = [*enumerate(texts), (3, texts[4]), (None, "q r " * 20)]
    got = periodic_runs.document_runs(frame(spark, rows).repartition(3)).collect()
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = runs_of(w) if len(w) < 9000 else [(0, len(w), 1)] if w[0] == "same" else []
        gone = {k for s, n, d in runs for k in range(s + d, s + n)}
        want.append((i, len(w), *([list(c) for c in zip(*runs, strict=True)] or [[], [], []]), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    digests = periodic_runs.run_digests(frame(spark, rows)).where("doc_id = 20").first()
    assert (digests.n_runs, digests.start, digests.length, digests.period, digests.exponent_milli) == (1, 0, 90_000, 1, 90_000_000)
    assert digests.runs_sha256 == hashlib.sha256(b"0,90000,1\n").hexdigest() and digests.collapsed_sha256 == hashlib.sha256(b"same").hexdigest()
    assert periodic_runs.run_digests(frame(spark, rows).limit(0), rearranged=periodic_runs.planted).count() == 0


# --- toxicity


def kernel(a, b):
    """By listing all subsequences."""
    import itertools

    def of(s):
        out = Counter()
        for i in range(len(s)):
            for k in (2, 3):
                for more in itertools.combinations(range(i + 1, min(i + toxicity.SPAN, len(s))), k):
                    sub = s[i] + "".join(s[j] for j in more)
                    if toxicity.GAP not in sub:
                        out[sub] += toxicity.DECAY ** (more[-1] - i - k)
        return out

    x, y = of(a), of(b)
    return sum(v * y[u] for u, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()) or 1)


def test_kernel_against_all_subsequences():
    rng = random.Random(4)
    strings = ["".join(rng.choice("abcä\0") for _ in range(rng.randrange(toxicity.WINDOW + 1))) for _ in range(40)] + ["aaaaaaa", "ab", "", "a" * toxicity.WINDOW]
    got = toxicity.Landmarks(strings[:25]).kernel(strings)
    assert np.allclose(got, [[kernel(a, b) for b in strings[:25]] for a in strings])
    marks, w = toxicity.Landmarks(strings[:25]), np.random.default_rng(0).normal(size=26)
    assert np.allclose(marks.machine(w).margins(strings), got @ w[:-1] + w[-1])


def test_toxic_documents_are_found(spark):
    rng = random.Random(6)
    syllables = "ba ce di fo gu ha ke li mo nu pra ste tri".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3])))
    insults = ["dumbhead", "wortwurm", "zilchbrain", "krobbel"]

    def text(toxic, spell=lambda x: x):
        w = [word() for _ in range(60)]
        for x in rng.sample(insults, 3) if toxic else []:
            w.insert(rng.randrange(61), spell(x))
        return ". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))

    rows = [(i, text(i % 4 == 0)) for i in range(600)]
    spellings = [lambda x: " ".join(x), lambda x: ".".join(x), lambda x: x[:3] + "x" + x[3:], lambda x: x[:4] + "-" + x[4:], lambda x: x.upper() + "!", lambda x: x + "s"]
    hard = [(1000 + i, text(True, spellings[i % 6])) for i in range(60)] + [(2000 + i, text(False)) for i in range(200)]
    odd = [(3000, None), (3001, ""), (3002, " . "), (3003, "krobbel " * 200_000), (None, "krobbel dumbhead wortwurm"), (3004, "z" * 4000), (8, rows[8][1]), (8, rows[9][1])]
    docs = frame(spark, rows + hard + odd)
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(600)] + [(8, 1), (9, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    taught = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    machine = toxicity.fit(docs, labels, taught)
    got = {}
    for r in toxicity.toxicity(docs, machine).collect():
        assert 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows + hard + odd) and len(got[8]) == 3
    import zlib

    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i][0].score >= 0.5) == (i % 4 == 0) for i in held)
    assert all(got[2000 + i][0].score < 0.5 for i in range(200))
    assert sum(got[1000 + i][0].score >= 0.5 for i in range(60)) >= 50
    assert all(got[i][0].score < 0.5 for i in (3000, 3001, 3002, 3004)) and got[3000][0].score == got[3001][0].score and got[None][0].score >= 0.5
    top = got[held[0] if held[0] % 4 == 0 else next(i for i in held if i % 4 == 0)][0]
    assert any(x in top.sentence for x in insults) and len(top.sentence) < 140
    # without labels of both classes nothing is toxic
    for known in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.toxicity(docs, toxicity.fit(docs, known, taught)).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


def test_logistic_curve():
    x, y = np.random.default_rng(0).normal(size=(400, 3)), np.zeros(400)
    y[x[:, 0] + x[:, 1] > 0.3] = 1
    curve = toxicity.fit_curve(x, y)
    assert (curve[:-1] >= 0).all() and ((x @ curve[:-1] + curve[-1] > 0) == (y == 1)).mean() > 0.97
    assert toxicity.fit_curve(-x, y)[:-1].max() < 0.2
