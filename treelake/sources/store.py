"""A stored index: the tree as Parquet tables, built once and scanned by every query.

``entries`` (files and links), ``dirs``, ``xattrs`` and ``external`` (side databases), plus ``top_info``, one row for
each tree that was loaded.  Entries are laid out by directory level and sorted by change time inside a file, so that
level filters drop folders and time filters drop row groups.
"""

from __future__ import annotations

import os
import platform
import time
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_COLUMNS = (
    "name string, type string, inode string, mode long, nlink long, uid long, gid long, size long, blksize long, blocks long, atime long, mtime long, ctime long, linkname string, "
    "xattrs array<struct<name: string, value: string>>, crtime long, ossint1 long, ossint2 long, ossint3 long, ossint4 long, osstext1 string, osstext2 string, pinode string"
)
ENTRIES = [c.strip().split(" ")[0] for c in ENTRY_COLUMNS.replace("array<struct<name: string, value: string>>", "array").split(",")]
DIR_COLUMNS = ENTRY_COLUMNS + ", path string, level int, start string"
EXTERNAL_COLUMNS = "type string, pinode string, filename string, mode long, uid long, gid long"
TOP_COLUMNS = "name string, start double, end double, duration double, threads long, src string, system string, os string, cpu string, memory long, fstype string, storage string, notes string"


class Store:
    """Tables of a folder.  ``entries`` carry the directory's path and level as ``dpath`` and ``level``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def entries(self) -> DataFrame:
        return self._read("entries")

    @cached_property
    def dirs(self) -> DataFrame:
        return self._read("dirs")

    @cached_property
    def external(self) -> DataFrame:
        return self._read("external")

    @cached_property
    def xattrs(self) -> DataFrame:
        """(inode, name, value) of entries and directories."""
        both = self.entries.select("inode", "xattrs").unionByName(self.dirs.select("inode", "xattrs"))
        return both.select("inode", F.explode("xattrs").alias("x")).select("inode", "x.name", "x.value")

    @property
    def top_info(self) -> DataFrame:
        return self._read("top_info")


def build_index(entries: DataFrame, dirs: DataFrame, path: str, external: DataFrame | None = None, *, name: str = "", source: str = "", notes: str = "") -> Store:
    """Write a tree's tables under ``path``: ``entries`` of ENTRY_COLUMNS and ``dirs`` of DIR_COLUMNS, in any order.

    The one join of an index, entries with their directory, happens here and not in every query.
    """
    spark, began = dirs.sparkSession, time.time()
    where = dirs.select(F.col("inode").alias("pinode"), F.col("path").alias("dpath"), "level", "start")
    full = entries.select(*ENTRIES).join(where, "pinode")
    full.repartition("level", F.pmod(F.xxhash64("pinode"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).sortWithinPartitions("level", "mtime").write.mode("overwrite").partitionBy("level").parquet(f"{path}/entries")
    dirs.write.mode("overwrite").parquet(f"{path}/dirs")
    (external if external is not None else spark.createDataFrame([], EXTERNAL_COLUMNS)).write.mode("overwrite").parquet(f"{path}/external")
    top_insert(spark, path, name or path, began, time.time(), source, notes)
    return Store(spark, path)


def top_insert(spark: SparkSession, path: str, name: str, start: float, end: float, src: str = "", notes: str = "") -> None:
    """Append the provenance of a run to ``top_info``."""
    row = (name, float(start), float(end), float(end - start), spark.sparkContext.defaultParallelism, src, platform.node(), platform.platform(), platform.machine(), os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"), "", "", notes)
    spark.createDataFrame([row], TOP_COLUMNS).coalesce(1).write.mode("append").parquet(f"{path}/top_info")


def top_set(spark: SparkSession, path: str, name: str, **values) -> None:
    """Change columns of the rows of ``name``."""
    rewrite(spark, f"{path}/top_info", lambda t: t.withColumns({c: F.when(F.col("name") == name, F.lit(v)).otherwise(F.col(c)).cast(t.schema[c].dataType) for c, v in values.items()}))


def top_delete(spark: SparkSession, path: str, name: str) -> None:
    rewrite(spark, f"{path}/top_info", lambda t: t.where(~F.col("name").eqNullSafe(F.lit(name))))


def rewrite(spark: SparkSession, table: str, change) -> None:
    """Replace a stored table by ``change`` of it: the new files are whole before the old ones go."""
    new, hadoop = table + ".new", spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = spark.read.parquet(table)
    levels = [c for c in ("level",) if table.endswith("/entries")]
    change(old).write.mode("overwrite").partitionBy(*levels).parquet(new)
    fs = hadoop(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(table), True)
    fs.rename(hadoop(new), hadoop(table))


def update(store: Store, table: str, where: Column, **values: Column) -> None:
    """UPDATE in place of a stored table."""
    rewrite(store.spark, f"{store.path}/{table}", lambda t: t.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))
    store.__dict__.pop(table, None)


def delete(store: Store, table: str, where: Column) -> None:
    """DELETE from a stored table; rows for which ``where`` is null stay."""
    rewrite(store.spark, f"{store.path}/{table}", lambda t: t.where(~F.coalesce(where, F.lit(False))))
    store.__dict__.pop(table, None)


def insert(store: Store, table: str, rows: DataFrame) -> None:
    """INSERT into a stored table."""
    out = rows.select(*store._read(table).columns).write.mode("append")
    (out.partitionBy("level") if table == "entries" else out).parquet(f"{store.path}/{table}")
    store.__dict__.pop(table, None)
