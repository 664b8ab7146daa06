"""Mixing sources to target weights by soft membership.

A document belongs to each domain with a probability.  Domains are the classes of a labelled table (here quality and toxic
together); a naive Bayes classifier on hashed words, learnt from labelled documents, predicts the posteriors.  Each
document gets a nonnegative rate, its expected number of copies, such that the expected tokens of each domain, the sum of rate x
tokens x posterior, come as near as can be (least squares, relative to the domains' sizes) to the target weights' shares
of the budget.

Rates are found by projected gradient.  A step from rate r of a document with posteriors p is
max(0, r - step * sum over domains of p * (domain's tokens - its target) / domain's size), so a pass over (tokens, posteriors)
sums a number per domain; nothing else comes to the driver.  Every `STAGE` passes the rates are written to a table, which ends their lineage.

All of it is DataFrame expressions.  The classifier is fitted on at most `most_labelled` labelled documents, chosen by a hash of
doc_id; its table of word weights has BUCKETS rows, so both may be sent to all tasks.  Texts are not shuffled.

Defined results: a null or empty text has no tokens and the prior's posteriors; labels with a null are left out, and of several for a
doc_id the greatest of each kind count; without labels all domains are equally likely.  Rows that repeat a doc_id are
documents of their own; without documents there are no rates, and all targets are 0; further columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import words_of
from .shared import written

#: Domains in the labels' order: quality + 2 * toxic
DOMAINS = ("plain", "good", "plain_toxic", "good_toxic")
TARGETS = {"plain": 0.25, "good": 0.70, "plain_toxic": 0.01, "good_toxic": 0.04}
BUCKETS, SMOOTHING = 1 << 14, 0.02
MOST_LABELLED = 20_000
PASSES, STAGE, NEAR, STEP = 48, 12, 1e-4, 1.0
#: Words count as independent evidence up to so many; longer texts' evidence is scaled down to that
EVIDENCE = 40.0


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[DataFrame, list[float]]:
    """(bucket, weights): of each bucket of words, each domain's log likelihood; and the domains' log priors."""
    clean = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    domain = (F.when(F.col("q") > 0, 1).otherwise(0) + F.when(F.col("t") > 0, 2).otherwise(0)).alias("domain")
    chosen = clean.select("doc_id", domain).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = written(chosen)  # at most most_labelled rows of 12 bytes
    learnt = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    words = learnt.select("domain", F.explode(words_of(F.col("text"))).alias("word")).select("domain", _bucket(F.col("word")).alias("bucket"))
    own = [F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))]
    counts = written(words.groupBy("bucket").agg(*own))
    totals = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(DOMAINS))]).first()
    found = {r["domain"]: r["count"] for r in chosen.groupBy("domain").count().collect()}
    n = sum(found.values())
    priors = [math.log((found.get(k, 0) + 1) / (n + len(DOMAINS))) for k in range(len(DOMAINS))]
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    logs = [F.log((F.coalesce(F.col(f"n{k}"), F.lit(0)) + SMOOTHING) / (totals[k] + SMOOTHING * BUCKETS)).alias(f"w{k}") for k in range(len(DOMAINS))]
    return written(full.select("bucket", *logs)), priors


def posteriors(docs: DataFrame, weights: DataFrame, priors: list[float]) -> DataFrame:
    """(doc_id, key, n_tokens, p0, p1, ...) of each row of docs; key is xxhash64 of the text."""
    k = range(len(DOMAINS))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("i"), "text")
    words = rows.select("doc_id", "key", "i", F.explode_outer(words_of(F.col("text"))).alias("word"))
    words = words.select("doc_id", "key", "i", F.col("word").isNotNull().cast("int").alias("one"), F.coalesce(_bucket(F.col("word")), F.lit(0)).alias("bucket"))
    sums = words.join(F.broadcast(weights), "bucket").groupBy("doc_id", "key", "i").agg(F.sum("one").alias("n_tokens"), *[F.sum(F.col("one") * F.col(f"w{d}")).alias(f"s{d}") for d in k])
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest("n_tokens", F.lit(1)))
    sums = sums.select("doc_id", "key", "n_tokens", *[(F.lit(priors[d]) + F.col(f"s{d}") * scale).alias(f"l{d}") for d in k])
    top = F.greatest(*[F.col(f"l{d}") for d in k])
    sums = sums.select("doc_id", "key", "n_tokens", *[F.exp(F.col(f"l{d}") - top).alias(f"e{d}") for d in k])
    whole = sum((F.col(f"e{d}") for d in k[1:]), F.col("e0"))
    return sums.select("doc_id", "key", "n_tokens", *[(F.col(f"e{d}") / whole).alias(f"p{d}") for d in k])


def rates(members: DataFrame, targets: dict[str, float], budget: float | None = None) -> DataFrame:
    """members (n_tokens, p0, p1, ... and others) with the column rate.

    budget: the tokens wanted in all; None: as many as there are.
    """
    k = range(len(DOMAINS))
    p = [F.col(f"p{d}") for d in k]
    size = [x or 0.0 for x in members.agg(*[F.sum(F.col("n_tokens") * x) for x in p]).first()]
    whole = sum(targets.values())
    goal = [targets[name] / whole * (sum(size) if budget is None else budget) for name in DOMAINS]
    now, rate = members.withColumn("rate", F.lit(1.0)), F.col("rate")
    for i in range(1, PASSES + 1):
        total = [x or 0.0 for x in now.agg(*[F.sum(rate * F.col("n_tokens") * x) for x in p]).first()]
        if max(abs(t - g) for t, g in zip(total, goal, strict=True)) <= NEAR * max(sum(goal), 1.0):
            break
        change = [STEP * (t - g) / s if s > 0 else 0.0 for t, g, s in zip(total, goal, size, strict=True)]
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(c) * x for c, x in zip(change[1:], p[1:], strict=True)), F.lit(change[0]) * p[0]))
        if i % STAGE == 0:
            now, rate = written(now.withColumn("rate", rate)), F.col("rate")
    return now.withColumn("rate", rate)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, key, n_tokens, p0 ... (posteriors in the order of DOMAINS), rate of each row of docs (doc_id, text)."""
    weights, priors = classifier(docs, labels, most_labelled)
    return rates(written(posteriors(docs, weights, priors)), targets or TARGETS, budget)


def attained(members: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """domain, target, tokens, available, met of each domain, from what mixed() returned: tokens are those expected at the rates, available
    those at rates of 1, met whether tokens are within NEAR of the budget from the target.  A domain that no document has can't be met."""
    targets = targets or TARGETS
    sums = [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{d}") * x), F.lit(0.0)) for x in (F.col("rate"), F.lit(1.0)) for d in range(len(DOMAINS))]
    n, share = len(DOMAINS), sum(targets.values())
    one = members.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)])
    whole = F.lit(float(budget)) if budget is not None else sum((F.col(f"s{n + d}") for d in range(1, n)), F.col(f"s{n}"))
    rows = [F.struct(F.lit(name).alias("domain"), (whole * targets[name] / share).alias("target"), F.col(f"s{d}").alias("tokens"), F.col(f"s{n + d}").alias("available")) for d, name in enumerate(DOMAINS)]
    near = F.abs(F.col("tokens") - F.col("target")) <= F.greatest(F.col("goal") * NEAR, F.lit(NEAR))
    return one.select(whole.alias("goal"), F.explode(F.array(*rows)).alias("r")).select("goal", "r.*").withColumn("met", near).drop("goal")


def copies(rate: Column, key: Column) -> Column:
    """How often to take a document: its rate rounded up or down by a hash, so that the expected number is the rate."""
    part = (F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("int")).cast("long")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's posteriors, rate and copies."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mixed(docs, labels)
    return out.select("doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{name}") for i, name in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
