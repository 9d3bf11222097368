"""Outliers, snapshots and incremental differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hist as H
from ..sources.scratch import written


def sibling_outliers(tree: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """Per parent, children whose subtree value lies outside mean +- sigmas population deviations of all children."""
    # two aggregates a parent, joined back: a parent with very many children is aggregated map side
    stats = tree.groupBy("pinode").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    out = tree.join(stats, "pinode")
    far = (F.col("n") > 1) & ((F.col(value) < F.col("mean") - sigmas * F.col("sd")) | (F.col(value) > F.col("mean") + sigmas * F.col("sd")))
    return out.withColumn("outlier", far)


def find_outliers(tree: DataFrame, value: str, sigmas: float = 3.0) -> DataFrame:
    """From the root down: where children are outliers only they are followed, else all; a directory is reported when
    it is an outlier and has no children ("no-subdirs") or no outlier among them ("subdirs-not-outliers")."""
    marked = sibling_outliers(tree.select("inode", "pinode", "path", "level", value), value, sigmas).select("inode", "pinode", "path", "level", value, "outlier")
    kids = marked.groupBy("pinode").agg(F.bool_or("outlier").alias("any"), F.count(F.lit(1)).alias("k")).withColumnRenamed("pinode", "inode")
    nodes = written(marked.join(kids, "inode", "left").withColumn("any", F.coalesce("any", F.lit(False))))
    top = nodes.agg(F.max("level")).first()[0] or 0
    frontier, found = nodes.where("level = 0"), None
    for level in range(top + 1):
        here = frontier.where("outlier and not any").select("path", "level", F.when(F.col("k").isNull(), "no-subdirs").otherwise("subdirs-not-outliers").alias("outlier_type"), F.col(value).alias("value"))
        found = here if found is None else found.unionByName(here)
        go = frontier.where("k is not null and not (outlier and not any)").select(F.col("inode").alias("pinode"), F.col("any").alias("chosen"))
        frontier = written(nodes.join(go, "pinode").where("not chosen or outlier").drop("chosen"))
        if frontier.isEmpty():
            break
        if level % 16 == 15:
            found = written(found)
    return found


def incremental_diff(index: DataFrame, tree: DataFrame) -> DataFrame:
    """Changes from ``index`` to ``tree``: one full outer join on inode, classified."""
    a = index.select("inode", F.col("path").alias("old_path"), F.col("pinode").alias("old_pinode"))
    b = tree.select("inode", F.col("path").alias("new_path"), F.col("pinode").alias("new_pinode"), "suspect")
    both = a.join(b, "inode", "full_outer")
    kind = F.when(F.col("new_path").isNull(), "deleted").when(F.col("old_path").isNull(), "created").when((F.col("old_pinode") != F.col("new_pinode")) | (F.col("old_path") != F.col("new_path")), "moved").when(F.col("suspect") == 1, "suspect")
    return both.withColumn("change", kind).where(F.col("change").isNotNull())


def snapshot(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group and column of whole numbers: min, max, mean, median, population deviation, number of distinct values.

    Values are counted first, by group, column and value, so a group of any size is pre-aggregated map side; no task
    holds a group's values.
    """
    long = df.select(*by, F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c).cast("long"))]).alias("__c", "__v"))
    seen = written(long.groupBy(*by, "__c", "__v").agg(F.count(F.lit(1)).alias("__n")), "snapshot")
    x, n = F.col("__v").cast("double"), F.sum("__n")
    some = F.when(F.col("__v").isNotNull(), F.col("__n"))
    one = seen.groupBy(*by, "__c").agg(n.alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"), (F.sum(x * some) / F.sum(some)).alias("mean"), F.count("__v").alias("unique"))
    spread = seen.join(one.select(*by, "__c", "mean"), [*by, "__c"]).groupBy(*by, "__c").agg(F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * some) / F.sum(some)).alias("stdevp"))
    rows = one.join(spread, [*by, "__c"]).join(medians(seen, [*by, "__c"], "__v", "__n"), [*by, "__c"], "left")
    at = lambda c, f: F.max(F.when(F.col("__c") == c, F.col(f))).alias(f"{c}_{f}")
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *[at(c, f) for c in columns for f in ("min", "max", "mean", "median", "stdevp", "unique")])


def medians(df: DataFrame, by: list[str], column: str, weight: str | None = None) -> DataFrame:
    """(by..., median): exact medians of whole numbers in groups of any size, nulls apart; no group meets in a task.

    A radix select: values are cut into four digits of 16 bits, the highest first.  A pass counts the digits of the
    values that share the digits found so far with the middle rank, at most 65,536 counts a group, and takes the next
    one.  Even groups follow both middle ranks and give their mean.  ``weight``: how often a row counts, where ``df`` is
    a staged table of counts already; else values are counted and staged first.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    # the sign bit is turned round, so that digits of negative numbers sort before others
    v = df.where(F.col(column).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    if weight is None:
        v = written(v.groupBy(*keys, "v").agg(F.sum("w").alias("w")), "values")
    n = v.groupBy(*keys).agg(F.sum("w").alias("n"))
    # digits that all values share are known beforehand: small numbers need one pass
    ends = [x & ((1 << 64) - 1) for x in v.agg(F.min("v"), F.max("v")).first() if x is not None]
    shifts = [s for s in (48, 32, 16, 0) if ends and (s == 0 or ends[0] >> s != ends[1] >> s)]
    shared = ends[0] >> (shifts[0] + 16) if shifts and shifts[0] < 48 else 0
    target = n.select(*keys, F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rank"), F.lit(shared).cast("long").alias("found")).distinct()
    target = target.withColumn("which", F.col("rank"))
    for shift in shifts:
        digit = F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(65535)).cast("int")
        above = F.lit(0).cast("long") if shift == 48 else F.shiftrightunsigned("v", shift + 16)
        counts = v.select(*keys, above.alias("found"), digit.alias("digit"), "w").groupBy(*keys, "found", "digit").agg(F.sum("w").alias("c"))
        cond = F.lit(True)
        t = target.select(*[F.col(k).alias(f"t{k}") for k in keys], F.col("found").alias("tfound"), "rank", "which")
        for a, b in [*((f"t{k}", k) for k in keys), ("tfound", "found")]:
            cond = cond & F.col(a).eqNullSafe(F.col(b))
        here = counts.join(t, cond).select(*keys, "found", "digit", "c", "rank", "which")
        w = Window.partitionBy(*keys, "which").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        here = here.withColumn("upto", F.sum("c").over(w)).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        target = written(here.select(*keys, (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), (F.shiftleft("found", 16) + F.col("digit")).alias("found"), "which"), "medians")
    value = F.col("found").bitwiseXOR(F.lit(-(1 << 63))).cast("double")
    return target.groupBy(*keys).agg(F.avg(value).alias("median")).select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "median")


VIEWS = {"graph": [], "level": ["level"], "siblings": ["pinode"], "pinode": ["pinode"], "directory": ["inode"], "inode": ["inode"]}


def full_snapshot(df: DataFrame, view: str, columns: list[str], ref: int) -> DataFrame:
    """A longitudinal snapshot: per group of a view and column min, max, mean, median, mode, population deviation, number
    of distinct values, and a histogram: of ages for columns of times, of octal modes, of powers of two for the rest.

    One row per (group, column), so the width doesn't grow with the columns; values are counted once, by group, column
    and value, and everything but the median comes from those counts.
    """
    by = VIEWS[view]
    value = F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c).cast("long"))]).alias("column", "value")
    long = df.select(*by, value)
    seen = written(long.where("value is not null").groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("c")), "snapshot")
    n, x = F.sum("c"), F.col("value").cast("double")
    mean = F.sum(x * F.col("c")) / n
    basic = seen.groupBy(*by, "column").agg(
        n.alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), mean.alias("mean"), F.count(F.lit(1)).alias("num_unique"),
        F.max(F.struct("c", "value")).alias("top"), F.max_by("c", F.struct("c", "value")).alias("most"),
    )
    keys = [*by, "column"]
    tied = seen.join(basic.select(*keys, "most", "mean"), keys)
    more = tied.groupBy(*keys).agg(F.count_if(F.col("c") == F.col("most")).alias("ties"), F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * F.col("c")) / n).alias("stdevp"))
    times = [c for c in columns if c.endswith("time")]
    bucket = F.when(F.col("column").isin(*times), H.time_bucket(F.col("value"), ref).cast("long")).when(F.col("column") == "mode", F.col("value").bitwiseAND(F.lit(511))).otherwise(H.log_bucket(F.col("value"), 2, 64).cast("long"))
    parts = seen.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("c").alias("c"))
    item = F.struct("bucket", F.concat(F.when(F.col("column") == "mode", F.lpad(F.conv(F.col("bucket").cast("string"), 10, 8), 3, "0")).otherwise(F.col("bucket").cast("string")), F.lit(":"), F.col("c").cast("string"), F.lit(";")).alias("txt"))
    hist = parts.groupBy(*keys).agg(H.text_of(F.collect_list(item)).alias("hist"))
    out = basic.join(more, keys).join(hist, keys).join(medians(seen, keys, "value", "c"), keys)
    return out.select(*keys, "n", "min", "max", "mean", "median", F.when(F.col("ties") == 1, F.col("top.value")).alias("mode"), "stdevp", "num_unique", "hist")


def level_distances(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(l2, cosine) of two snapshots by level: all columns of all levels are one vector, and a level that one of them
    lacks counts as zeros there."""
    wide = lambda df, s: df.select("level", *[F.col(c).cast("double").alias(f"{c}{s}") for c in columns])
    both = wide(left, "_l").join(wide(right, "_r"), "level", "full_outer").na.fill(0.0)
    over = lambda f: F.sum(sum((f(F.col(f"{c}_l"), F.col(f"{c}_r")) for c in columns), F.lit(0.0)))
    found = both.agg(over(lambda a, b: (a - b) * (a - b)).alias("d"), over(lambda a, b: a * b).alias("dot"), over(lambda a, b: a * a).alias("a"), over(lambda a, b: b * b).alias("b"))
    return found.select(F.sqrt("d").alias("l2"), F.try_divide(F.col("dot"), F.sqrt("a") * F.sqrt("b")).alias("cosine"))


def find_suspects(entries: DataFrame, dirs: DataFrame, method: int, since: int = 0, inodes: DataFrame | None = None, check_times: bool = False) -> DataFrame:
    """(inode): directories to look at again.  Method 0: none; 1: those whose inode is listed (``check_times``: and whose
    change or modification time is not before ``since``); 3: those that, or any of whose entries, changed since."""
    late = F.greatest("ctime", "mtime") >= since
    if method == 0:
        return dirs.select("inode").where("false")
    if method == 1:
        listed = dirs.join(inodes.select("inode"), "inode", "left_semi")
        return (listed.where(late) if check_times else listed).select("inode")
    if method != 3:
        raise ValueError(f"method {method}")
    return dirs.where(late).select("inode").union(entries.where(late).select("pinode")).distinct()


def top_by_group(df: DataFrame, by: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("size"), "name", "inode")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
