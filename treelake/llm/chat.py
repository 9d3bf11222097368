"""Chat formatting: logged snapshots of a conversation collapse into the longest one (DataFrame functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scope, attach, stage


def prefix_hashes(conversations: DataFrame, scope: Scope) -> DataFrame:
    """(conv, i, n, role, text, p, q): the i-th turn of n, and the rolling 128-bit hash of turns 1 to i.

    A turn's hash covers its position, role and text; a prefix is the exclusive-or of its turns.  Turns are sorted by
    range, so a conversation of very many lies in several parts: each is numbered and hashed apart, and the parts are
    chained by their sizes and totals.
    """
    t = conversations.where("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    t = scope.stage(t.orderBy("conv", *order).withColumn("part", F.spark_partition_id()), "turns_sorted")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("conv", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"), F.sum("m").over(Window.partitionBy("conv")).alias("n"))
    t = t.join(sizes, ["conv", "part"]).withColumn("i", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) + F.col("off"))
    t = t.withColumn("h", F.xxhash64("i", "role", "text")).withColumn("g", F.xxhash64(F.lit("turn"), "i", "role", "text"))
    so_far = Window.partitionBy("conv", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv", "part", "i", "n", "role", "text", F.bit_xor("h").over(so_far).alias("x"), F.bit_xor("g").over(so_far).alias("y"))
    t = scope.stage(t, "turns_hashed")
    ends = t.groupBy("conv", "part").agg(F.max_by("x", "i").alias("x"), F.max_by("y", "i").alias("y"))
    chain = ends.select("conv", "part", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("by"))
    return t.join(chain, ["conv", "part"]).select("conv", "i", "n", "role", "text", F.col("x").bitwiseXOR(F.col("bx")).alias("p"), F.col("y").bitwiseXOR(F.col("by")).alias("q"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """The conversations (conv) that are no prefix of a longer one; of identical ones the smallest id."""
    with Scope() as scope:
        keys = scope.stage(prefixes.select("conv", "i", "n", "p", "q"), "prefixes")
        seen = attach(keys.withColumnRenamed("n", "turns"), ["i", "p", "q"], [F.max("turns").alias("longest"), F.min(F.when(F.col("i") == F.col("turns"), F.col("conv"))).alias("first")], scope=scope)
        covered = seen.where("i = turns and (longest > turns or first < conv)").select("conv")
        return stage(keys.where("i = n").select("conv").join(covered, "conv", "left_anti"), "maximal")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations, one row each: ``conv_id, n_turns, rendered``.

    Turns are ordered by (turn, role, text), null turn numbers first; null roles and texts count as empty.  A row of a
    null conv_id belongs to no conversation and is left out; repeated rows are repeated turns.  Columns other than
    conv_id, turn, role and text are ignored.  Gaps in the turn numbers mean nothing.  A conversation is rendered
    whole, so the longest one must fit into a row, as a document's text must.
    """
    with Scope() as scope:
        turns = stage(prefix_hashes(conversations, scope), "chat_turns")
    keep = maximal_conversations(turns)
    lines = turns.join(keep, "conv", "left_semi").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"])), "\n")
    return lines.select(F.col("conv").alias("conv_id"), F.size("t").alias("n_turns"), text.alias("rendered"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM t),
g AS (SELECT i, prefix, max(n) AS longest, min(CASE WHEN i = n THEN conv_id END) AS first FROM p GROUP BY i, prefix),
k AS (SELECT conv_id FROM p JOIN g USING (i, prefix) WHERE i = n AND longest = n AND first = conv_id)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(concat('<|', role, '|>', chr(10), text), chr(10) ORDER BY i) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id
"""
