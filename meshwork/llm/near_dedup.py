"""MinHash near-dedup: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct word shingles.  Documents with equal sets are folded into one node first.  Each
node's fast similarity sketch (see textkit.fast_sketch) is cut into bands; nodes that share a band are candidates, and
banding.linked() finds their links: by the full sets, made again from the whole texts.  No bucket is expanded into all its
pairs, and no link within a bucket is lost but where both ends are known to be connected already.

With the defaults (240 coordinates in 40 bands of 6), two sets of similarity 0.8 share no band with probability
5e-6; at 0.9, 3e-14.

Defined results: an empty or null text has no shingle and is linked with nothing.  Rows are told apart by doc_id; rows
that repeat a doc_id are each linked by their own text.  A null doc_id gets the component of the other documents
with its text, and null if there are none.  Further columns of the input are ignored, an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .banding import linked
from .shared import written

def word_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = tk.Words(texts)
    return tk.distinct(*tk.shingles(words.hashes(lower=True), words.first, k))


def _sketched(k: int, n_bands: int, width: int, least: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                values, first = word_shingles(part.column("text"), k)
                n = np.diff(first)
                sketched = n >= least  # smaller sets are similar enough only if equal
                chosen = values[np.repeat(sketched, n)]
                keys = tk.bands(tk.fast_sketch(chosen, np.concatenate(([0], np.cumsum(n[sketched]))), n_bands * width), width)
                at = np.concatenate(([0], np.cumsum(np.where(sketched, n_bands, 0))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), tk.signed(tk.segment_sums(tk.mix(values), first)), tk.signed(tk.segment_sums(tk.mix(~values), first)), tk.lists(keys.reshape(-1), at)], ["doc_id", "key", "n", "d1", "d2", "bands"])

    return of


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, n_bands: int = 40, width: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key of each row of docs (doc_id, text); key is xxhash64 of the text."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # two unequal sets: at best n of n + 1
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_sketched(shingle, n_bands, width, least), f"doc_id {kind}, key long, n long, d1 long, d2 long, bands array<long>"))
    nodes = written(rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    texts = docs.select(F.col("doc_id").alias("id"), "text")

    label = linked(nodes, lambda ids: texts.join(ids, "id"), lambda t: word_shingles(t, shingle), percent)
    of_set = nodes.select("d1", "d2", "n", "id").join(label, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("rep"))
    out = rows.select("doc_id", "key", "n", "d1", "d2").join(of_set, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "key")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table's near-duplicate classes on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2).drop("key")
