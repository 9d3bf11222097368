"""Packing into optimal length buckets, then token-budget batches (DataFrame functions; a small DP on the driver)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import salt_of, stage, text_or_empty

#: Rows a shard of a bucket has on average, which bounds the window that numbers them.
SHARD_ROWS = 50_000


def token_length(text_col: str = "text") -> Column:
    """Tokens of a text: runs of characters other than ASCII white space (0 for null)."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+"))


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding, exactly.

    ``lengths`` ascending and distinct.  Padding of a bucket (i, j]: lengths[j] * rows - tokens.  This cost is Monge,
    so each layer of the DP is filled by divide and conquer over monotone choices; one level at a time.
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    k = min(buckets, n)
    # tokens are a constant of all choices, so the slots (bound * rows) alone are minimised
    best = lengths * rows[1:]
    choice = np.zeros((k, n), dtype=np.int64)
    for layer in range(1, k):
        new = np.full(n, np.inf)
        work = [(layer, n - 1, layer, n - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid) + 1)
            cost = best[i - 1] + lengths[mid] * (rows[mid + 1] - rows[i])
            at = int(np.argmin(cost))
            new[mid], choice[layer, mid] = cost[at], i[at]
            work += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = new
    bounds, j = [], n - 1
    for layer in range(k - 1, -1, -1):
        bounds.append(int(lengths[j]))
        j = int(choice[layer, j]) - 1
    return bounds[::-1]


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Exact distinct lengths, ascending, and their row counts; the lengths grow with the root of all tokens at most."""
    found = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n")).orderBy("len").toPandas()
    return found["len"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = 16,
    token_budget: int = 16_384,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, bucket_len, batch, slot, padding``.

    Bucket bounds minimise padding over the exact lengths of all documents, however long one is.  A bucket of bound L is cut, in the order of
    (shard, id, length), into batches of max(1, token_budget // L) documents; ``batch`` counts within a bucket and
    ``slot`` within a batch.  A document longer than the budget is a batch of its own, whole.  Rows are numbered
    per (bucket, shard) and shifted by the sizes of the shards before, so a bucket that holds a third of all rows is
    spread over many tasks.  Null and empty texts have length 0 and fall into the first bucket; rows with equal ids
    are told apart arbitrarily but stay whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(F.col(id_col).alias("id"), F.coalesce(length if length is not None else token_length(text_col), F.lit(0)).cast("long").alias("len")),
        "pack_len",
    )
    lens, counts = histogram(rows)
    bounds = bucket_bounds(lens, counts, buckets)
    if not bounds:
        return spark.createDataFrame([], SCHEMA)
    bucket, cap, start = F.lit(len(bounds) - 1), F.lit(1), 0
    shards = F.lit(1)
    total = np.concatenate([[0], np.cumsum(counts)])
    ends = np.searchsorted(lens, bounds, side="right")
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("len") <= bounds[k]
        n = int(total[ends[k]] - (total[ends[k - 1]] if k else 0))
        bucket = F.when(inside, F.lit(k)).otherwise(bucket)
        shards = F.when(inside, F.lit(max(1, -(-n // SHARD_ROWS)))).otherwise(shards)
    limit = F.array(*[F.lit(b).cast("long") for b in bounds])
    caps = F.array(*[F.lit(max(1, token_budget // max(1, b))).cast("long") for b in bounds])
    put = rows.select("id", "len", bucket.cast("int").alias("bucket"), F.pmod(F.xxhash64("id", "len"), shards).cast("int").alias("shard"))
    sizes = put.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = put.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "len")))
    at = F.col("before") + F.col("rn") - 1
    cap, bound = F.element_at(caps, F.col("bucket") + 1), F.element_at(limit, F.col("bucket") + 1)
    return numbered.join(sizes, ["bucket", "shard"]).select(
        F.col("id").alias("doc_id"),
        F.col("len").alias("n_tokens"),
        "bucket",
        bound.alias("bucket_len"),
        F.floor(at / cap).cast("long").alias("batch"),
        F.pmod(at, cap).cast("long").alias("slot"),
        (bound - F.col("len")).alias("padding"),
    )


SCHEMA = "doc_id long, n_tokens long, bucket int, bucket_len long, batch long, slot long, padding long"
