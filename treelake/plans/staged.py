"""The staged query: what runs for each tree summary, directory and entry, and what puts the results together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary as M
from ..sources.views import _over, view_frames

#: Names in braces that every query knows: the directory's name and path, and the source's prefix.
BUILT_IN = {"n": "dname", "i": "sname", "s": "__source"}


def substitute(sql: str, strings: dict[str, str], source: str = "") -> str:
    """``sql`` with each {key} replaced: by a column of the directory, or the user's expression.  {} stays as it is, an
    unknown key is an error."""

    def one(m: re.Match) -> str:
        key = m[1]
        if key in strings:
            return f"({strings[key]})"
        if key == "s":
            return "'" + source.replace("'", "''") + "'"
        if key in BUILT_IN:
            return BUILT_IN[key]
        raise ValueError(f"no user string {key!r}")

    return re.sub(r"\{([^{}]+)\}", one, sql)


def staged_query(
    spark: SparkSession, index, *, tree: str | None = None, summary: str | None = None, entries: str | None = None, then: str | None = None, final: str | None = None,
    process: int = 0, min_level: int = 0, max_level: int | None = None, paths: list[str] | None = None, skip: list[str] = (), strings: dict[str, str] | None = None, source: str = "",
) -> DataFrame:
    """Up to three queries on every directory, their rows put together, then ``then`` and ``final`` over these.

    ``tree`` selects from ``treesummary``; ``summary`` from vrsummary, ``entries`` from vrpentries and the other views
    of ``sources.views``.  A query that a later one waits for must select ``inode`` (or ``pinode``): ``summary`` runs
    where ``tree`` gave a row, ``entries`` where ``summary`` did (process 0); 1: ``tree`` is left out and ``entries``
    runs wherever ``summary`` gave a row; 2: every query runs on every directory.  The rows of the last query are
    ``intermediate``; ``then`` is SQL over that, whose rows are ``aggregate``, and ``final`` SQL over those; both are
    aggregated partially in each task and finally after a shuffle, whatever the tables in between were for.

    {key} in any of them stands for an expression of ``strings``, {n} for the directory's name, {i} for its path, {s}
    for the source's prefix.
    """
    from ..operators import find as P

    strings = strings or {}
    dirs = P.levels(index.dirs, min_level, max_level)
    if paths:
        dirs = P.path_list(dirs, paths)
    if skip:
        dirs = P.skip_names(dirs, list(skip))
    inside = dirs.select("inode")
    frames = view_frames(index.entries, dirs, index.xattrs)
    frames["entries"] = frames["entries"].join(inside.withColumnRenamed("inode", "pinode"), "pinode", "left_semi")
    if tree is not None or "treesummary" in " ".join(filter(None, (summary, entries))):
        made = M.tree_summary(M.dir_summary(index.entries, index.dirs))
        frames["treesummary"] = made.join(dirs.select("inode", "pinode", "path", "level", F.substring_index("path", "/", -1).alias("dname"), F.col("path").alias("sname")), "path")

    def run(sql: str, gate: DataFrame | None) -> DataFrame:
        sql, used = substitute(sql, strings, source), {}
        for name in sorted(frames, key=len, reverse=True):
            if re.search(rf"\b{name}\b", sql):
                df = frames[name]
                key = "pinode" if "entries" in name else "inode"
                used[name] = df if gate is None else df.join(gate.withColumnRenamed("dir", key), key, "left_semi")
        for name in used:
            sql = re.sub(rf"(\bfrom\s+|\bjoin\s+|,\s*){name}\b", lambda m, n=name: m[1] + "{" + n + "}", sql, flags=re.IGNORECASE)
        return spark.sql(sql, **{n: df for n, df in used.items() if "{" + n + "}" in sql})

    def gate_of(df: DataFrame) -> DataFrame:
        key = next((c for c in ("inode", "pinode") if c in df.columns), None)
        if key is None:
            raise ValueError("a query that another waits for selects inode or pinode")
        return df.select(F.col(key).alias("dir")).distinct()

    gate, out = None, None
    if tree is not None and process != 1:
        out = run(tree, None)
        if summary is not None or entries is not None:
            gate = gate_of(out) if process != 2 else None
    if summary is not None:
        out = run(summary, gate)
        if entries is not None:
            gate = gate_of(out) if process != 2 else None
    if entries is not None:
        out = run(entries, gate)
    if out is None:
        raise ValueError("nothing to run")
    if then is not None:
        out = _over(spark, substitute(then, strings, source), "intermediate", out)
    if final is not None:
        out = _over(spark, substitute(final, strings, source), "aggregate" if then is not None else "intermediate", out)
    return out


#: Queries by name: what they select, from which view, and the columns they may be filtered and grouped by.
TEMPLATES = {
    "files": ("vrpentries", "dname, name, size, uid, gid, mtime, atime, type", "type = 'f'"),
    "links": ("vrpentries", "dname, name, uid, gid, mtime, type", "type = 'l'"),
    "directories": ("vrsummary", "dname, sname, pinode, srollsubdirs", "true"),
    "attributes": ("vrxpentries", "dname, name, xattr_name, xattr_value", "xattr_name is not null"),
    "empty-files": ("vrpentries", "dname, name, uid, gid, mtime", "type = 'f' and size = 0"),
    "large-files": ("vrpentries", "dname, name, size, uid, gid", "type = 'f' and size > 1073741824"),
    "space": ("vrpentries", "count(*) as files, sum(size) as bytes", "type = 'f'"),
    "ages": ("vrpentries", "min(mtime) as oldest, max(mtime) as newest, count(*) as files", "type = 'f'"),
    "names": ("vrpentries", "count(*) as files", "type = 'f'"),
}


def template(spark: SparkSession, index, name: str, *, filters: dict[str, object] | None = None, group_by: list[str] = (), order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """A canned query with filters and groups.  A filter is column=value, or column=(operator, value); values are bound
    as parameters and never become part of the SQL."""
    view, cols, where = TEMPLATES[name]
    frame = view_frames(index.entries, index.dirs, index.xattrs)[view]
    args, parts = {}, [where]
    for k, (column, v) in enumerate((filters or {}).items()):
        op, value = v if isinstance(v, tuple) else ("=", v)
        if column not in frame.columns or op.lower() not in ("=", "<>", "<", "<=", ">", ">=", "like", "rlike"):
            raise ValueError(f"filter: {column} {op}")
        parts.append(f"{column} {op} :p{k}")
        args[f"p{k}"] = value
    for c in group_by:
        if c not in frame.columns:
            raise ValueError(f"group: {c}")
    grouped = ", ".join(group_by)
    frame.createOrReplaceTempView(f"__template_{view}")
    out = spark.sql(f"SELECT {grouped + ', ' if grouped else ''}{cols} FROM __template_{view} WHERE {' AND '.join(parts)}" + (f" GROUP BY {grouped}" if grouped else ""), args=args)
    if order_by:
        out = out.orderBy(F.desc(order_by.lstrip("-")) if order_by.startswith("-") else F.asc(order_by))
    return out if limit is None else out.limit(limit)
