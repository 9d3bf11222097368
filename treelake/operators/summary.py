"""Directory summaries, whole-subtree summaries, and the test for rolling a directory into its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

LOW, HIGH = (1 << 63) - 1, -(1 << 63)
ANY = ["uid", "gid", "mtime", "ctime", "atime"]


def _entry_aggs(extra: bool = True) -> list[Column]:
    f, link = F.col("type") == "f", F.col("type") == "l"
    size = F.when(f, F.col("size"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = lambda c: F.count_if(c)
    blocks = F.when(f, F.floor((F.col("size") + 511) / 512).cast("long"))
    return [
        n(f).alias("totfiles"), n(link).alias("totlinks"),
        F.min(size).alias("minsize"), F.max(size).alias("maxsize"), total(size).alias("totsize"),
        n(size == 0).alias("totzero"), n(size <= 1024).alias("totltk"), n(size > 1024).alias("totmtk"),
        n(size <= 1 << 20).alias("totltm"), n(size > 1 << 20).alias("totmtm"), n(size > 1 << 30).alias("totmtg"), n(size > F.lit(1 << 40)).alias("totmtt"),
        F.min(blocks).alias("minblocks"), F.max(blocks).alias("maxblocks"), total(blocks).alias("totblocks"),
        *[F.min(c).alias(f"min{c}") for c in ANY], *[F.max(c).alias(f"max{c}") for c in ANY],
        *[total(c).alias(f"tot{c}") for c in ("mtime", "ctime", "atime")],
    ]


def identity(df: DataFrame) -> DataFrame:
    """A directory without entries: minima at the largest number, maxima at the smallest, totals 0."""
    fill = lambda c: F.lit(LOW) if c.startswith("min") else F.lit(HIGH) if c.startswith("max") else F.lit(0).cast("long")
    return df.select(*[F.coalesce(F.col(c), fill(c)).alias(c) if c[:3] in ("min", "max", "tot") else F.col(c) for c in df.columns])


#: Columns beyond those of ``dir_summary``, where a tree has them.
MORE = ["crtime", "ossint1", "ossint2", "ossint3", "ossint4"]


def full_summary(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """``dir_summary`` with birth times, the site's own numbers and the number of extended attributes, and the stat
    columns and depth of the directory itself.  ``xattrs`` is an array or their number."""
    attrs = F.size("xattrs") if dict(entries.dtypes).get("xattrs", "").startswith("array") else F.col("xattrs")
    aggs = [f(c).alias(f"{n}{c}") for c in MORE for f, n in ((F.min, "min"), (F.max, "max"))]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"tot{c}") for c in MORE] + [F.coalesce(F.sum(attrs), F.lit(0)).cast("long").alias("totxattr")]
    per = entries.groupBy("pinode").agg(*_entry_aggs(), *aggs).withColumnRenamed("pinode", "inode")
    out = identity(dirs.join(per, "inode", "left"))
    return out.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))


def full_tree_summary(summary: DataFrame) -> DataFrame:
    """``tree_summary`` of ``full_summary``: birth times merge where a directory holds files, the rest always."""
    has = F.col("totfiles") > 0
    aggs = [F.sum("totxattr").cast("long").alias("totxattr"), F.max("depth").alias("maxdepth")]
    for c in MORE:
        use = (lambda x: F.when(has, F.col(x))) if c == "crtime" else F.col
        aggs += [F.min(use(f"min{c}")).alias(f"min{c}"), F.max(use(f"max{c}")).alias(f"max{c}"), F.coalesce(F.sum(use(f"tot{c}")), F.lit(0)).cast("long").alias(f"tot{c}")]
    out = identity(closure(summary).groupBy("ancestor").agg(*_tree_aggs(), *aggs)).withColumnRenamed("ancestor", "path")
    return out.withColumn("maxdepth", F.col("maxdepth").cast("int"))


def dir_summary(entries: DataFrame, dirs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per directory (and per value of ``by``, for directories that have entries of it)."""
    keys = ["pinode", *(by or [])]
    aggs = [a for a in _entry_aggs()]
    per = entries.groupBy(*keys).agg(*aggs).withColumnRenamed("pinode", "inode")
    if by:
        return identity(per)
    return identity(dirs.select("inode", "pinode", "level", "path").join(per, "inode", "left"))


def closure(dirs: DataFrame) -> DataFrame:
    """Each directory with every ancestor's path, its own included; as many rows as the sum of depths."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    return dirs.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


_SUMS = ["totfiles", "totlinks", "totsize", "totzero", "totltk", "totmtk", "totltm", "totmtm", "totmtg", "totmtt", "totblocks"]
_MINS = ["minsize", "minuid", "mingid", "minmtime", "minctime", "minatime"]
_TIMES = ["totmtime", "totctime", "totatime"]


def tree_summary(summary: DataFrame) -> DataFrame:
    """One row per directory over its whole subtree, from directory summaries.

    Minima, maxima and time totals come from directories that hold files; sizes and counts from all.  Children are first
    added up by their parent, so that only parents are repeated for their ancestors, not every directory.
    """
    has = F.col("totfiles") > 0
    sums = {"totsubdirs": F.lit(1).cast("long")} | {c: F.col(c) for c in _SUMS} | {c: F.when(has, F.col(c)) for c in _TIMES}
    mins = {c: F.when(has, F.col(c)) for c in _MINS}
    maxs = {c.replace("min", "max"): F.when(has, F.col(c.replace("min", "max"))) for c in _MINS} | {"maxsubdirfiles": F.col("totfiles"), "maxsubdirlinks": F.col("totlinks"), "maxsubdirsize": F.col("totsize")}
    merge = [F.sum(c).cast("long").alias(c) for c in sums] + [F.min(c).alias(c) for c in mins] + [F.max(c).alias(c) for c in maxs]
    own = summary.select("path", *[e.alias(c) for c, e in (sums | mins | maxs).items()])
    parent = F.when(F.instr("path", "/") == 0, "").otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    cols = list(sums | mins | maxs)
    # the root counts for nobody's children; a filter instead would reach the tables, and summaries would move twice
    kids = own.select(parent.alias("path"), *[F.when(F.col("path") != "", F.col(c)).alias(c) for c in cols]).groupBy("path").agg(*merge)
    rows = closure(kids).select("ancestor", *cols).unionByName(own.select(F.col("path").alias("ancestor"), *cols))
    out = rows.groupBy("ancestor").agg(*merge).withColumn("totsubdirs", F.col("totsubdirs") - 1)
    return identity(out).withColumnRenamed("ancestor", "path")


def one_tree_summary(summary: DataFrame, path: str = "") -> DataFrame:
    """``tree_summary`` of a single directory: its subtree is cut out first, so nothing is repeated for ancestors."""
    mine = summary if path == "" else summary.where((F.col("path") == path) | F.col("path").startswith(path + "/"))
    return identity(mine.groupBy(F.lit(path).alias("path")).agg(*_tree_aggs()))


def _tree_aggs() -> list[Column]:
    has = F.col("totfiles") > 0
    when = lambda c: F.when(has, F.col(c))
    sums, mins = _SUMS, _MINS
    return [
        (F.count(F.lit(1)) - 1).alias("totsubdirs"), F.max("totfiles").alias("maxsubdirfiles"), F.max("totlinks").alias("maxsubdirlinks"), F.max("totsize").alias("maxsubdirsize"),
        *[F.sum(c).cast("long").alias(c) for c in sums],
        *[F.min(when(c)).alias(c) for c in mins], *[F.max(when(c.replace("min", "max"))).alias(c.replace("min", "max")) for c in mins],
        *[F.coalesce(F.sum(when(c)), F.lit(0)).cast("long").alias(c) for c in _TIMES],
    ]


def rollup_legal(p: str, c: str) -> Column:
    """May a child directory's rows be read wherever its parent's may?  Parent and child columns by prefix."""
    mode = lambda x, b: F.col(f"{x}mode").bitwiseAND(F.lit(b))
    same = lambda *n: [F.col(f"{p}{x}") == F.col(f"{c}{x}") for x in n]
    uid, gid = same("uid", "gid")
    open_ = (mode(p, 5) == 5) & (mode(c, 5) == 5) & uid & gid
    equal = lambda b: mode(p, b) == mode(c, b)
    return open_ | (equal(0o555) & uid & gid) | (equal(0o550) & uid & gid) | (equal(0o500) & uid)


def rollup_fixpoint(dirs: DataFrame) -> DataFrame:
    """(inode, rolled): leaves are; others where all children are and every parent-child pair is legal.

    That is where no pair below is illegal: such pairs are handed up by pointers to ancestors that double in every
    pass, so passes grow with the logarithm of the depth, whatever it is.
    """
    pairs = dirs.select("inode", "pinode", *[F.col(x).alias(f"c{x}") for x in ("mode", "uid", "gid")]).join(dirs.select(F.col("inode").alias("pinode"), *[F.col(x).alias(f"p{x}") for x in ("mode", "uid", "gid")]), "pinode")
    pairs = pairs.where("inode <> pinode").select("inode", F.col("pinode").alias("up"), rollup_legal("p", "c").alias("legal"))
    bad = pairs.where("not legal").select(F.col("up").alias("inode"), F.lit(True).alias("bad")).distinct()
    nodes = dirs.select("inode").join(pairs.select("inode", "up"), "inode", "left").join(bad, "inode", "left")
    nodes = written(nodes.select("inode", "up", F.coalesce("bad", F.lit(False)).alias("bad")))
    while not nodes.where("up is not null").isEmpty():
        hit = nodes.where("bad and up is not null").select(F.col("up").alias("inode"), F.lit(True).alias("hit")).distinct()
        jump = nodes.select(F.col("inode").alias("up"), F.col("up").alias("next"))
        nodes = nodes.join(hit, "inode", "left").join(jump, "up", "left")
        nodes = written(nodes.select("inode", F.col("next").alias("up"), (F.col("bad") | F.coalesce("hit", F.lit(False))).alias("bad")))
    return nodes.select("inode", (~F.col("bad")).alias("rolled"))


def rollup_plan(dirs: DataFrame, summary: DataFrame, *, limit: int | None = None, min_level: int = 0) -> DataFrame:
    """(inode, path, level, rolled, subdirs, entries, before, after, why): which directories are rolled up, and why not.

    ``limit``: most files and links that a directory may hold alone (``before``) and with what is rolled into it
    (``after``); ``min_level``: directories above it are never rolled up.  A directory is rolled up if every one below
    it is, every parent-child pair is legal and the limit holds; as entries only grow upwards, that is where none of
    its subtree breaks a rule, so one pass over ancestors decides all.
    """
    legal = rollup_fixpoint(dirs)
    own = summary.select("inode", "path", "level", (F.col("totfiles") + F.col("totlinks")).alias("entries"))
    whole = closure(own.select("path", "entries")).groupBy(F.col("ancestor").alias("path")).agg(F.sum("entries").cast("long").alias("after"))
    kids = dirs.where("inode <> pinode").groupBy(F.col("pinode").alias("inode")).agg(F.count(F.lit(1)).alias("subdirs"))
    out = own.join(whole, "path").join(legal, "inode").join(kids, "inode", "left").withColumns({"subdirs": F.coalesce("subdirs", F.lit(0).cast("long")), "before": F.col("entries")})
    over = lambda c: F.lit(False) if limit is None else F.col(c) > limit
    why = F.when(F.col("level") < min_level, "not processed").when(~F.col("rolled"), "permissions").when(over("before"), "too many before").when(over("after"), "too many after")
    return out.withColumn("why", why).withColumn("rolled", F.col("why").isNull()).select("inode", "path", "level", "rolled", "subdirs", "entries", "before", "after", "why")


def rollup_statistics(plan: DataFrame) -> DataFrame:
    """One row per fate of a directory (rolled up, or why not): how many, how many of them empty, and of subdirectories,
    entries and levels the least, greatest, mean and median."""
    from .analyses import medians

    p = written(plan.withColumn("fate", F.coalesce("why", F.lit("rolled up"))).withColumn("level", F.col("level").cast("long")), "plan")
    of = ["subdirs", "entries", "level"]
    kind = dict(plan.dtypes)
    aggs = [(f(c) if n == "mean" else f(c).cast(kind[c])).alias(f"{c}_{n}") for c in of for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    out = p.groupBy("fate").agg(F.count(F.lit(1)).alias("dirs"), F.count_if(F.col("entries") == 0).alias("empty"), F.sum("entries").alias("total"), *aggs)
    for c in of:
        out = out.join(medians(p, ["fate"], c).withColumnRenamed("median", f"{c}_median"), "fate")
    return out
