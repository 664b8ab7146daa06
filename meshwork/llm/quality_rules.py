"""Quality rules: a document's own counts, and cross-document line frequency.

Own rules: a document fails if it has fewer than 50 words, or if more than half of its words lie in 3-word windows that
occur twice or more in it.  Cross-document rule: normalised lines (lower case, trimmed, runs of digits as 0) are
hashed, and the distinct documents with the line are counted per host; copies of a text count as one document.
Lines of more than `most_docs` documents of a host are removed from all of them but the first (least doc_id),
which keeps each line once in the corpus.  A document that keeps less than `least_kept` percent of its words is
depleted and rejected.  judged() has counts and verdicts on texts as they are, kept_documents() the texts without those lines.

All of it is DataFrame expressions.  What is shuffled are hashes and numbers of lines; kept_documents() also joins
the texts with the numbers of their lines to remove.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; rows that
repeat a doc_id, its text and its host get equal results, and count as one document; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the contract
WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50
#: A line of more documents of one host is boilerplate
MOST_DOCS = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often later expressions name them: Catalyst doesn't
    merge a projection into a generator."""
    new = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(new)))


def own_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others but text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    df = _once(df, _words=words_of(text), _lines=lines).drop("text")
    df = df.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = _once(df, _runs=F.transform(starts, lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)]))).drop("_words")
    repeats = F.size(F.array_distinct("_runs")) < F.size("_runs")
    df = _once(df, _by_run=F.when(repeats, F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_runs")
    same = lambda x, j, by: F.coalesce(x["h"] == F.get("_by_run", j + by)["h"], F.lit(False))
    again = F.filter("_by_run", lambda x, j: same(x, j, -1) | same(x, j, 1))
    df = _once(df, _at=F.array_sort(F.transform(again, lambda x: x["i"]))).drop("_by_run")
    covered = F.transform("_at", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - i, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_at")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _host(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def frequent_lines(docs: DataFrame, host: str, most_docs: int) -> DataFrame:
    """(doc_id, key, all): of each document the lines to remove, once each however many rows repeat it, as host, at (number
    from 0) and n (words); key is xxhash64 of the text."""
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), _host(F.col(host)).alias("host"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    form = F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "0")
    lines = lines.select("doc_id", "key", "host", "at", F.xxhash64(form).alias("hash"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    once = lines.groupBy("host", "hash", "key").agg(F.min("doc_id").alias("first"))
    # written, so that Spark can split a frequent line's rows in the join
    frequent = once.groupBy("host", "hash").agg(F.count("*").alias("m"), F.min("first").alias("home")).where(F.col("m") > most_docs).select("host", "hash", "home")
    gone = lines.join(written(frequent), ["host", "hash"]).where(~F.col("doc_id").eqNullSafe(F.col("home")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct("host", "at", "n")).alias("all"))


def _with_frequent(own: DataFrame, frequent: DataFrame) -> DataFrame:
    """own (_d, _k, _h and others) with _gone, the lines to remove under the row's host, and n_frequent, their words."""
    same = F.col("_d").eqNullSafe(F.col("y.doc_id")) & (F.col("_k") == F.col("y.key"))
    out = own.alias("x").join(frequent.alias("y"), same, "left").select("x.*", F.filter("y.all", lambda x: x["host"] == F.col("_h")).alias("_gone"))
    return out.withColumn("n_frequent", F.coalesce(F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long")))


def _enough(n_words: str, least_kept: int) -> Column:
    return 100 * (F.col(n_words) - F.col("n_frequent")) >= least_kept * F.col(n_words)


def judged(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, least_kept: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_frequent of each row."""
    own = own_counts(docs.select("doc_id", "text", F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), _host(F.col(host)).alias("_h")))
    out = _with_frequent(own, frequent_lines(docs, host, most_docs)).drop("_d", "_k", "_h", "_gone")
    return out.withColumn("kept", ~F.col("base_failed") & _enough("n_words", least_kept))


def kept_documents(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, least_kept: int = 30) -> DataFrame:
    """The rows of docs that pass, their text without the lines to remove, their other columns as they were."""
    own = own_counts(docs.select(F.struct(*docs.columns).alias("_row"), "text")).where(~F.col("base_failed"))
    own = own.select("_row", F.col("_row.doc_id").alias("_d"), F.xxhash64("_row.text").alias("_k"), _host(F.col(f"_row.`{host}`")).alias("_h"), F.col("n_words").alias("_n"))
    out = _with_frequent(own, frequent_lines(docs, host, most_docs)).where(_enough("_n", least_kept))
    text = F.col("_row.text")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone.at", i)), "\n")
    return out.select(*[F.when(F.coalesce(F.size("_gone"), F.lit(0)) <= 0, text).otherwise(left).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, md5(text) AS key, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, doc_id, key, host, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT *, regexp_replace(lower(trim(line)), '[0-9]+', '0', 'g') AS form, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM ln GROUP BY r),
x AS (SELECT r, i, w[i : i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT j) AS n_rep FROM (SELECT r, unnest(range(i, i + 3)) AS j FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM x) WHERE c > 1) GROUP BY r),
freq AS (SELECT host, form, min(doc_id) AS home FROM ln GROUP BY host, form HAVING count(DISTINCT key) > 10),
gone AS (SELECT r, sum(n) AS n_freq FROM ln JOIN freq USING (host, form) WHERE doc_id IS DISTINCT FROM home GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
             coalesce(n_rep, 0) AS n_repeat_words, CAST(coalesce(n_freq, 0) AS BIGINT) AS n_frequent
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_frequent) >= 30 * n_words AS kept FROM c"""
