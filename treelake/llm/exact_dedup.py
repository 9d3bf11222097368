"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Leaves: every row falls into one of ``runs`` runs by its place in the staged table, so that copies of one text, rows of
one id and rows without an id are spread over all of them.  A run is sorted by digest and holds one record per digest:
smallest or largest id, row count.  Rounds are binomial: in round r the runs whose bit r is set send their records to
the run with that bit cleared, where sorted segments meet in a multiway merge (sort-based aggregation: every sender's
segment is sorted and combined before it is sent, the receiver merges the segments in digest order and folds neighbours
of equal digest).  After log2(runs) rounds run 0 holds one record per digest.  A run is no task: each is spread over
hash slices of the digest, which are sorted on their own.

The result walks down the same tree: at each level a record meets the two runs it came from, so a text that makes up a
third of all rows is never joined in one task: a leaf run holds about RUN_ROWS rows, whatever their texts.

Verification at every level: the merge key is SHA-256, byte length and a second 64-bit hash of another family, so
records merge only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty

KEY = ["sha", "size", "check"]
#: Rows of a leaf run on average; a table has so many runs that this holds, 8 at least, a power of two.
RUN_ROWS = 4_000_000


def digest_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, sha, size, check) of each row; a null text is the empty one, a null id is kept as null."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("at"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).alias("size"),
        F.xxhash64(text).alias("check"),
    )


def _merge(records: DataFrame, keep: Column, n: Column) -> DataFrame:
    """One record per run and digest.  The id is picked inside a struct, which has no fixed place in an aggregation
    buffer: so Spark aggregates by sorting, on the senders' side as well as on the receivers'."""
    return records.groupBy("run", *KEY).agg(keep.alias("keep"), n.alias("n")).select("run", *KEY, F.col("keep.id").alias("keep"), "n")


def leaf_runs(rows: DataFrame, keep: str) -> DataFrame:
    """Sorted runs of (run, sha, size, check, keep, n) of the rows."""
    pick = F.max if keep == "largest" else F.min
    # null ids come last for the smallest, first for the largest: they never win against others
    known = F.when(F.col("id").isNotNull(), F.struct("id"))
    return _merge(rows, pick(known), F.count(F.lit(1)))


def merge_round(records: DataFrame, bit: int, keep: str) -> DataFrame:
    """One round: runs with ``bit`` set send theirs to the run with it cleared; one record per digest is left there."""
    pick = F.max if keep == "largest" else F.min
    known = F.when(F.col("keep").isNotNull(), F.struct(F.col("keep").alias("id")))
    return _merge(records.withColumn("run", F.col("run").bitwiseAND(~(1 << bit))), pick(known), F.sum("n"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep``: which id of equal texts stays, "smallest" or "largest".  Null texts count as empty and equal one
    another.  Null ids never win against others; where a group has null ids only, keep_id is null and its rows are
    kept.  Repeated rows (same id and text) are each
    reported, all with kept true where the id is the one that stays.  An empty table gives an empty result.  Other
    columns of the input are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    rows = stage(digest_records(docs, id_col, text_col), "exact_rows")
    bits = max(3, (max(1, rows.count()) // run_rows).bit_length())
    rows = rows.withColumn("run", F.pmod(F.xxhash64("at"), F.lit(1 << bits)).cast("int")).drop("at")
    levels = [stage(leaf_runs(rows, keep), "exact_run")]
    for bit in range(bits):
        levels.append(stage(merge_round(levels[-1], bit, keep), "exact_run"))
    down = levels.pop()
    for bit in reversed(range(bits)):
        child = levels.pop().select(F.col("run").alias("child"), *KEY)
        child = child.withColumn("run", F.col("child").bitwiseAND(~(1 << bit)))
        down = child.join(down, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "keep", "n")
    return rows.join(down, ["run", *KEY]).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
