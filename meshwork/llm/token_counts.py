"""Token counts: an exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded whole by an existing byte-level BPE vocabulary and counted by their number of tokens.  The
histogram has a row for each length that occurs.  Its suffix sums (documents and tokens of at least a length) answer, for the
limit of each row: how many documents exceed it, what truncation to it leaves, and which share of documents fits; quantiles are
the least lengths that enough documents fit.  Limits between two rows follow from the next row.

Suffix sums are taken in blocks of `BLOCK` lengths and then over blocks, so that no task gets the whole histogram.

Defined results: a null or empty text has no tokens; strings that look like special tokens are ordinary text; repeated rows
count each; further columns are ignored, whatever their names; an empty table has an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut before merging
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128


def _lengths(path: str, cut: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=cut, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(x)) if (x := t.as_py()) else 0 for t in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "text"), pa.array(n)], [*(f.name for f in batch.schema if f.name != "text"), "n_tokens"])

    return of


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, cut: str = CUT) -> DataFrame:
    """doc_id, n_tokens of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_lengths(vocabulary, cut), f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs) for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length as a limit: docs (of just this length), docs_longer, tokens_kept (of all documents cut to the
    limit), tokens_cut, tokens_in_longer, share_fitting."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(all_).alias("all_d"), F.sum("t").over(all_).alias("all_t"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"docs_longer": F.coalesce(F.sum("docs").over(longer), F.lit(0)), "tokens_in_longer": F.coalesce(F.sum("tokens").over(longer), F.lit(0))}).join(blocks, "block")
    h = h.withColumns({"docs_longer": F.col("docs_longer") + F.col("d_after"), "tokens_in_longer": F.col("tokens_in_longer") + F.col("t_after")})
    cut = F.col("tokens_in_longer") - F.col("docs_longer") * F.col("n_tokens")
    return h.select("n_tokens", "docs", "docs_longer", "tokens_in_longer", (F.col("all_t") - cut).alias("tokens_kept"), cut.alias("tokens_cut"), (1 - F.col("docs_longer") / F.col("all_d")).alias("share_fitting"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents doesn't exceed."""
    least = [F.min(F.when(F.col("share_fitting") >= s, F.col("n_tokens"))).alias(str(i)) for i, s in enumerate(shares)]
    return limits.agg(*least).select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(str(i)).alias("n_tokens")) for i, s in enumerate(shares)])).alias("x")).select("x.*")


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """The totals for a limit that need not occur as a length: docs_longer, tokens_in_longer, tokens_cut."""
    longer = limits.where(F.col("n_tokens") > limit).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("tokens_in_longer"))
    return longer.withColumn("tokens_cut", F.col("tokens_in_longer") - limit * F.col("docs_longer"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' length histogram with its totals for every limit."""
    # written, as it's small and read twice: the texts are encoded once
    return limits(written(length_histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))))
