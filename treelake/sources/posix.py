"""Walk a file system that all executors mount, one level of directories at a time.

A round lists all directories of one level in parallel; their subdirectories are the next round's.  Nothing but the
number of rounds depends on depth, and the driver never holds names.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .store import DIR_COLUMNS, EXTERNAL_COLUMNS, Store, build_index

#: Names a line of this file in a directory registers a side database.
EXTERNAL_LIST = "external.list"


def _xattrs(path: str) -> list[tuple[str, str]]:
    out = []
    try:
        for n in os.listxattr(path, follow_symlinks=False):
            out.append((n, os.getxattr(path, n, follow_symlinks=False).decode("utf-8", "replace")))
    except OSError:
        pass
    return sorted(out)


def _row(path: str, name: str, st: os.stat_result, pinode: str, with_xattrs: bool) -> tuple:
    kind = "d" if stat.S_ISDIR(st.st_mode) else "l" if stat.S_ISLNK(st.st_mode) else "f"
    link = os.readlink(path) if kind == "l" else ""
    return (
        name, kind, str(st.st_ino), st.st_mode, st.st_nlink, st.st_uid, st.st_gid, st.st_size, st.st_blksize, st.st_blocks, int(st.st_atime), int(st.st_mtime), int(st.st_ctime), link,
        _xattrs(path) if with_xattrs else [], int(getattr(st, "st_birthtime", 0)), 0, 0, 0, 0, "", "", pinode,
    )


_NAMES = ["name", "type", "inode", "mode", "nlink", "uid", "gid", "size", "blksize", "blocks", "atime", "mtime", "ctime", "linkname", "xattrs", "crtime", "ossint1", "ossint2", "ossint3", "ossint4", "osstext1", "osstext2", "pinode", "path", "level", "start"]


def _list(with_xattrs: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, inode, level, start in zip(f["path"], f["inode"], f["level"], f["start"]):
                here, rows = os.path.join(start, path) if path else start, []
                try:
                    found = sorted(os.scandir(here), key=lambda e: e.name)
                except OSError:
                    continue
                for e in found:
                    try:
                        st = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    if stat.S_ISDIR(st.st_mode) or stat.S_ISREG(st.st_mode) or stat.S_ISLNK(st.st_mode):
                        rows.append((*_row(e.path, e.name, st, inode, with_xattrs), f"{path}/{e.name}" if path else e.name, int(level) + 1, start))
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)

    return run


def walk(spark: SparkSession, roots: list[str], *, max_level: int | None = None, path_list: list[str] | None = None, skip: list[str] = (), xattrs: bool = True, enter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, dirs) of the trees under ``roots``; paths are relative to their root, which is level 0.

    ``path_list``: only these subtrees; ``skip``: names of directories left out with all below them; ``enter``: a
    condition on a directory's columns without which it is neither kept nor entered.  Directories that can't be read
    are kept without entries.  Sockets, pipes and devices are passed over.
    """
    first = []
    for r in map(os.path.abspath, roots):
        for p in path_list or [""]:
            here = os.path.join(r, p) if p else r
            st = os.stat(here)
            up = str(os.stat(os.path.dirname(here)).st_ino) if p else ""
            first.append((*_row(here, os.path.basename(here), st, up, xattrs), p, p.count("/") + 1 if p else 0, r))
    level = dirs = written(spark.createDataFrame(first, DIR_COLUMNS), "walk")
    entries = None
    while True:
        if max_level is not None:
            level = level.where(F.col("level") <= max_level)
        # a directory is a long task where it holds very many names: they are spread one by one
        n = level.count()
        if n == 0:
            break
        found = written(level.select("path", "inode", "level", "start").repartition(min(n, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(_list(xattrs), DIR_COLUMNS), "walk")
        here = found.where("type <> 'd'").drop("path", "level", "start")
        entries = here if entries is None else entries.unionByName(here)
        level = found.where("type = 'd'")
        if skip:
            level = level.where(~F.col("name").isin(*skip))
        if enter is not None:
            level = level.where(enter)
        dirs = dirs.unionByName(level if max_level is None else level.where(F.col("level") <= max_level))
    return entries if entries is not None else dirs.where("false").drop("path", "level", "start"), dirs


def external_databases(spark: SparkSession, dirs: DataFrame, check: bool = False) -> DataFrame:
    """Side databases that directories list by name in EXTERNAL_LIST, one path a line; relative ones lie in the directory.

    ``check`` leaves out those that aren't files.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, inode, start in zip(f["path"], f["inode"], f["start"]):
                here = os.path.join(start, path) if path else start
                try:
                    with open(os.path.join(here, EXTERNAL_LIST)) as listed:
                        names = [x.rstrip("\n") for x in listed]
                except OSError:
                    continue
                for n in filter(None, names):
                    full = os.path.join(here, n)
                    if os.path.isfile(full):
                        st = os.stat(full)
                        rows.append(("user_db", inode, full, st.st_mode, st.st_uid, st.st_gid))
                    elif not check:
                        rows.append(("user_db", inode, full, None, None, None))
            yield pd.DataFrame(rows, columns=["type", "pinode", "filename", "mode", "uid", "gid"]).astype({"mode": "Int64", "uid": "Int64", "gid": "Int64"})

    return dirs.select("path", "inode", "start").mapInPandas(run, EXTERNAL_COLUMNS)


def index_tree(spark: SparkSession, roots: list[str], path: str, **options) -> Store:
    """Walk ``roots`` and store the index under ``path``."""
    entries, dirs = walk(spark, roots, **options)
    return build_index(entries, dirs, path, external_databases(spark, dirs), source=",".join(roots))
