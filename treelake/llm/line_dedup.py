"""Line dedup: a suffix array over line-id sequences by prefix doubling (DataFrame functions only).

The sequence of a document is its lines that hold a word.  Round 0 ranks lines, round k + 1 ranks blocks of 2**(k+1)
lines by the pair of ranks of their halves: after round k the ranks order all suffixes by their first 2**k lines.
Only blocks that occur again are ranked: a block that occurs once is resolved and can't be part of a longer repeat.
Suffixes of equal rank form the interval of longest common prefix >= 2**k; its first place (smallest document, then
line) is the original and every other place of the interval a later copy.  Doubling ends when no interval is left.
The exact common prefix of a maximal run and its original follows by binary descent over the ranks: from 2**k lines
on, 2**j further lines are taken wherever both places have the same rank of round j.

What goes: later copies of repeated runs of at least ``min_lines`` lines (a power of two), and of single lines of at
least ``min_words`` words.  As every window of ``min_lines`` lines of a longer repeated run is itself a repeated
block, the union of such later blocks is exactly the union of all maximal repeated runs that occur earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, Scope, salt_of, stage, text_or_empty

SPACE = r"\x20\x09-\x0D"


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """(doc, seq, pos, long, a, b): the lines with a word; pos counts all lines, seq these; a, b are a 128-bit id.

    long: at least ``min_words`` words; the pattern ends with the last word it asks for and never goes back.
    """
    found = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.filter(found, lambda s: s["line"].rlike(f"[^{SPACE}]")).alias("lines"))
    long = F.col("s.line").rlike(f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{max(0, min_words - 1)}}}[^{SPACE}]")
    return lines.select("doc", F.posexplode("lines").alias("seq", "s")).select("doc", "seq", F.col("s.pos").alias("pos"), long.alias("long"), F.xxhash64("s.line").alias("a"), F.xxhash64(F.lit("line"), "s.line").alias("b"))


#: Places that share a salt on average, where a table has more than SALTS times as many.
SALT_ROWS = 4_000_000


def rank_repeats(blocks: DataFrame, scope: Scope, salts: int = SALTS) -> DataFrame:
    """Rank the repeated (a, b) of ``blocks`` and attach rank, first place and count to each place of them.

    Salted partial groups, merged, sorted by range, numbered in that order, and joined back by (key, salt): a key
    that holds a third of all rows is spread over ``salts`` partial groups.
    """
    salted = blocks.withColumn("salt", salt_of("doc", "seq", salts=salts))
    part = salted.groupBy("a", "b", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "seq")).alias("first"))
    part = scope.stage(part, "line_part")
    whole = part.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    ranked = scope.stage(whole.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), "line_rank")
    down = part.select("a", "b", "salt").join(ranked, ["a", "b"])
    return salted.join(down, ["a", "b", "salt"]).drop("salt")


def repeated_blocks(lines: DataFrame, scope: Scope) -> list[DataFrame]:
    """The intervals of each round: (doc, seq, rank, first, n), from length 1 by doubling until none is left."""
    salts = max(SALTS, lines.count() // SALT_ROWS)
    with Scope() as own:
        found = rank_repeats(lines.select("doc", "seq", "a", "b"), own, salts)
        # rows that repeat an id repeat its places: one of them is enough, and texts that differ under one id keep the lowest rank
        found = found.groupBy("doc", "seq").agg(F.min(F.struct("rank", "first", "n")).alias("r")).select("doc", "seq", "r.*")
        rounds = [scope.stage(found, "line_round")]
    while True:
        here, step = rounds[-1], 1 << (len(rounds) - 1)
        after = here.select("doc", (F.col("seq") - step).alias("seq"), F.col("rank").alias("b"))
        pairs = here.select("doc", "seq", F.col("rank").alias("a")).join(after, ["doc", "seq"])
        with Scope() as own:
            found = scope.stage(rank_repeats(pairs, own, salts).select("doc", "seq", "rank", "first", "n"), "line_round")
        if found.isEmpty():
            return rounds
        rounds.append(found)


def _later(r: DataFrame) -> DataFrame:
    return r.where((F.col("first.doc") != F.col("doc")) | (F.col("first.seq") != F.col("seq")))


def later_copies(lines: DataFrame, rounds: list[DataFrame], *, min_lines: int = 2) -> DataFrame:
    """(doc, seq) of the lines to delete, some of them several times."""
    q = min_lines.bit_length() - 1
    if min_lines < 1 or 1 << q != min_lines:
        raise ValueError("min_lines: a power of two")
    long = lines.where("long").select("doc", "seq")
    out = _later(rounds[0]).join(long, ["doc", "seq"], "left_semi").select("doc", "seq")
    if q < len(rounds):
        blocks = _later(rounds[q]).select("doc", F.explode(F.sequence("seq", F.col("seq") + min_lines - 1)).alias("seq"))
        out = out.unionByName(blocks)
    return out


def maximal_runs(rounds: list[DataFrame], least: int, scope: Scope) -> DataFrame:
    """(doc, seq, first, len): the maximal runs of at least ``least`` lines (a power of two) that occur earlier.

    A run starts where the place before isn't the same run's: not a later copy of the place before its original.  The
    original is the first place of the longest doubling block; len is the whole common prefix with it.
    """
    q = least.bit_length() - 1
    if q >= len(rounds):
        return rounds[0].where("false").select("doc", "seq", "first", F.lit(0).alias("len"))
    parts = [_later(r).select("doc", "seq", F.struct(F.lit(k).alias("k"), "first").alias("top")) for k, r in enumerate(rounds) if k >= q]
    places = parts[0]
    for x in parts[1:]:
        places = places.unionByName(x)
    places = places.groupBy("doc", "seq").agg(F.max("top").alias("top")).select("doc", "seq", "top.k", "top.first")
    w = Window.partitionBy("doc").orderBy("seq")
    before = F.lag(F.struct("seq", "first")).over(w)
    same = (before["seq"] == F.col("seq") - 1) & (before["first"]["doc"] == F.col("first.doc")) & (before["first"]["seq"] == F.col("first.seq") - 1)
    runs = scope.stage(places.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").select("doc", "seq", "first", "k", F.expr("shiftleft(1, k)").alias("len")), "line_starts")
    for j in range(len(rounds) - 2, -1, -1):
        todo = runs.where(F.col("k") > j)
        ranks = rounds[j].select(F.col("doc").alias("d"), F.col("seq").alias("s"), "rank")
        mine = todo.join(ranks, (F.col("doc") == F.col("d")) & (F.col("seq") + F.col("len") == F.col("s"))).drop("d", "s").withColumnRenamed("rank", "mine")
        both = mine.join(ranks, (F.col("first.doc") == F.col("d")) & (F.col("first.seq") + F.col("len") == F.col("s")) & (F.col("mine") == F.col("rank")))
        more = both.select("doc", "seq", F.lit(1 << j).alias("more"))
        runs = scope.stage(runs.join(more, ["doc", "seq"], "left").select("doc", "seq", "first", "k", (F.col("len") + F.coalesce("more", F.lit(0))).alias("len")), "line_runs")
    return runs.select("doc", "seq", "first", "len")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 10) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted, plus ``lines_removed`` and ``longest_run``.

    Lines are separated by newline characters; lines without a word are never counted nor deleted, but a run of
    deleted lines closes up.  Earlier means: smaller id, then smaller line number; copies within one document count
    as well.  Null texts and rows with a null id pass unchanged, as do empty texts; rows of equal id are one document
    to the order and get the same line numbers deleted.  ``longest_run``: lines of the longest deleted run, as far as
    it agrees with its original (0: none).  All columns of the input come back; those named lines_removed or
    longest_run are replaced.
    """
    with Scope() as scope:
        lines = scope.stage(line_table(docs, id_col, text_col, min_words), "line_table")
        rounds = repeated_blocks(lines, scope)
        gone = later_copies(lines, rounds, min_lines=min_lines).distinct()
        runs = maximal_runs(rounds, max(2, min_lines), scope).groupBy("doc").agg(F.max("len").cast("long").alias("len"))
        per = lines.select("doc", "seq", "pos").join(gone, ["doc", "seq"]).groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
        # a document without a run of two lines or more lost single lines
        per = per.join(runs, "doc", "left").select(F.col("doc").alias("__doc"), "__gone", F.coalesce("len", F.lit(1).cast("long")).alias("__run"))
        per = stage(per, "line_gone")
    # the lines travel through the join as an array, so that the deletion below looks them up instead of splitting again
    arrays = docs.where(F.col(id_col).isNotNull()).withColumn("__lines", F.split(F.col(text_col), "\n", -1)).drop(text_col)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.element_at("__lines", i + 1))
    # what is deleted grows with the documents: a broadcast would serve small tables only, and hide what larger ones cost
    out = arrays.join(per.hint("merge"), arrays[id_col] == per["__doc"], "left")
    text = F.array_join(F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(left), "\n").alias(text_col)
    names = [c for c in docs.columns if c not in ("lines_removed", "longest_run")]
    out = out.select(*[text if c == text_col else F.col(c) for c in names], F.coalesce(F.size("__gone"), F.lit(0)).alias("lines_removed"), F.coalesce("__run", F.lit(0).cast("long")).alias("longest_run"))
    # rows without an id need no join, however many there are
    rest = docs.where(F.col(id_col).isNull()).select(*names, F.lit(0).alias("lines_removed"), F.lit(0).cast("long").alias("longest_run"))
    return out.unionByName(rest)
