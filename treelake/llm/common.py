"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salted partial groups per key in ``attach``; bounds a hot key's share of one task to 1/SALTS.
SALTS = 64

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``; a local one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="treelake_")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _write(df, name)[0]


class Scope:
    """Tables staged for one step; ``close`` (or leaving a ``with``) deletes their files once nothing reads them."""

    def __init__(self):
        self.found: list[tuple[SparkSession, str]] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.found.append((df.sparkSession, path))
        return out

    def close(self) -> None:
        for spark, name in self.found:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.found = []

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def salt_of(*cols: str | Column, salts: int = SALTS) -> Column:
    """A salt that depends on row identity only, so that a recomputed task sees the same one."""
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(salts)).cast("int")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def sample_labels(labels: DataFrame, label_col: str, fold: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` (id, label, turn) rows of either class (0 and 1) whose id passes ``fold``; the same ones at any time.

    Rows are picked by a hash of their id; rows of one id count once, with the larger label.  A class that is larger
    is first thinned by that hash to little more than ``most``, so that no task sorts more than a few times as many.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    one = one.groupBy("id").agg(F.max("label").alias("label")).where(fold).withColumn("pick", F.pmod(F.xxhash64(F.lit("pick"), "id"), F.lit(1 << 40)))
    found = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def take(y: int) -> DataFrame:
        mine, n = one.where(F.col("label") == y), found.get(y, 0)
        if n > 2 * most:
            mine = mine.where(F.col("pick") < int((1 << 40) * (most + 10 * most**0.5 + 100) / n))
        return mine.orderBy("pick", "id").limit(most) if n > most else mine

    # the order of training is drawn apart from the choice: a class cut by its picks would else come first
    return take(0).unionByName(take(1)).select("id", "label", F.xxhash64(F.lit("turn"), "id").alias("turn"))


#: ``attach`` broadcasts groups that hold more than 1/HOT_SHARE of all rows: HOT_SHARE rows at most, at any size.
HOT_SHARE = 10_000


def attach(rows: DataFrame, keys: list[str], aggs: list[Column], having: str = "true", *, scope: Scope) -> DataFrame:
    """``rows`` with the aggregates of their group (and its size ``n``); groups failing ``having`` are left out.

    Groups are pre-aggregated map side.  The join back sends cold groups through a shuffle; a hot one, which might
    fill a whole task, meets its group's single row by a broadcast of at most HOT_SHARE rows instead.  ``rows`` is
    read up to three times, so it should be a staged table or close to one.  ``scope`` holds the groups until the
    result has been written.
    """
    groups = scope.stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs).where(F.expr(having) | F.expr("n > 1000")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    least = max(total // HOT_SHARE, 1000)
    wanted = groups.where(having)
    hot = wanted.where(F.col("n") > least)
    if hot.isEmpty():
        return rows.join(wanted, keys)
    cold = rows.join(F.broadcast(groups.where(F.col("n") > least).select(*keys)), keys, "left_anti").join(wanted.where(F.col("n") <= least), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def look_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table``, in which ``key`` is unique; keys of many rows meet it by a broadcast of at
    most HOT_SHARE rows.  Both should be staged."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    least = max((rows.count()) // HOT_SHARE, 1000)
    hot = counts.where(F.col("__n") > least).select(key)
    if hot.isEmpty():
        return rows.join(table, key, "left")
    found = F.broadcast(table.join(F.broadcast(hot), key, "right"))
    return rows.join(found, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """Staged (node, component) of the nodes of the undirected ``edges`` (a, b): component is its smallest node.

    Alternating large-star and small-star rounds; each halves the distance to the smallest node, so rounds grow with
    the logarithm of a component's diameter.  Nothing but counters reaches the driver, and a round's tables are
    deleted as soon as the next has read them.
    """
    last = Scope()
    star = last.stage(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    mark = None
    while True:
        with Scope() as scope:
            # large star: every larger neighbour of a node is linked to the node's smallest neighbour
            both = scope.stage(star.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(star.select(F.col("m").alias("u"), F.col("v").alias("w"))), "both")
            low = attach(both, ["u"], [F.min("w").alias("low")], scope=scope)
            large = low.where("w > u").select(F.col("w").alias("v"), F.least("low", "u").alias("m"))
            large = scope.stage(large.where("v <> m").distinct(), "large")
            # small star: the smaller neighbours of a node are linked to the smallest of them
            low = scope.stage(attach(large, ["v"], [F.min("m").alias("low")], scope=scope).select("v", "m", "low"), "low")
            small = low.select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(low.select("v", F.col("low").alias("m")))
            made = Scope()
            star = made.stage(small.where("v <> m").distinct(), "star")
        last.close()
        last = made
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = star.select(F.col("m").alias("node")).distinct()
    out = stage(star.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    last.close()
    return out
