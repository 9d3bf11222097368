"""find, ls, stat, du and getfattr: the arguments a user gives, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.scalar import blocksize, glob_to_regex, human_readable_size, modetotxt
from ..operators import find as P
from ..operators import summary as M

C = F.col
#: Columns of ``listing`` that a tree may lack, and what stands for them.
DEFAULTS = {"nlink": 1, "blksize": 4096, "blocks": 0, "crtime": 0, "mode": 0, "uid": 0, "gid": 0, "size": 0, "atime": 0, "mtime": 0, "ctime": 0}


def listing(entries: DataFrame, dirs: DataFrame, users: DataFrame | None = None, groups: DataFrame | None = None, start: str = "", placed: DataFrame | None = None) -> DataFrame:
    """Files, links and directories in one table: their stat columns, ``path`` below the start, ``level`` of the
    directory that holds them (their own for directories), ``start``, ``user`` and ``group``.

    ``users`` (uid, user) and ``groups`` (gid, group) name owners; both are lookup tables of bounded size.  ``placed``:
    the entries with ``dpath`` and ``dlevel`` of their directory, where a source has them already joined; if they have
    ``user`` too, only directories are joined with ``users``.
    """
    up = dirs.select(C("inode").alias("pinode"), C("path").alias("dpath"), C("level").alias("dlevel"))
    e = placed if placed is not None else entries.drop("dpath", "dlevel", "level", "path", "start").join(up, "pinode")
    e = e.withColumns({"path": F.concat_ws("/", F.nullif("dpath", F.lit("")), "name"), "level": C("dlevel")})
    d = dirs.withColumns({"name": F.substring_index("path", "/", -1), "type": F.lit("d")})
    kids = entries.groupBy(C("pinode").alias("inode")).agg(F.count(F.lit(1)).alias("entries"))
    d = d.join(kids, "inode", "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("long")))
    shown = ["name", "type", "inode", "pinode", "path", "level"]

    def full(df: DataFrame, more: list[Column]) -> DataFrame:
        have = lambda c, v: C(c).cast("long").alias(c) if c in df.columns else F.lit(v).cast("long").alias(c)
        text = lambda c: C(c) if c in df.columns else F.lit("").alias(c)
        return df.select(*shown, *[have(c, v) for c, v in DEFAULTS.items()], text("linkname"), *more)

    def named(df: DataFrame, table: DataFrame | None, key: str, name: str) -> DataFrame:
        return df.join(table.select(key, name), key, "left") if table is not None else df.withColumn(name, F.lit(None).cast("string"))

    owned = placed is not None and "user" in placed.columns
    files, folders = full(e, [F.lit(None).cast("long").alias("entries"), *[C("user")] * owned]), full(d, [C("entries")])
    out = files.unionByName(named(folders, users, "uid", "user")) if owned else named(files.unionByName(folders), users, "uid", "user")
    return named(out.withColumn("start", F.lit(start)), groups, "gid", "group")


def _any(values, f) -> Column:
    out = F.lit(False)
    for v in values if isinstance(values, (list, tuple)) else [values]:
        out = out | f(v)
    return out


def conditions(now: int, **args) -> Column:
    """All conditions of find, ANDed, over the columns of ``listing``; several values of one are ORed where find does.

    amin, cmin, mmin, atime, ctime, mtime, anewer, cnewer, newer (a time), empty, executable, readable, writable,
    true, false, gid, uid, inum, links, size, group, user, name, iname, path, regex, iregex, lname, perm, samefile
    (an inode), type.
    """
    rules = {
        **{k: lambda v, t=t: P.compare(P.minutes_since(t, now), v) for k, t in (("amin", "atime"), ("cmin", "ctime"), ("mmin", "mtime"))},
        **{t: lambda v, t=t: P.compare(P.days_since(t, now), v) for t in ("atime", "ctime", "mtime")},
        **{k: lambda v, t=t: C(t) > v for k, t in (("anewer", "atime"), ("cnewer", "ctime"), ("newer", "mtime"))},
        "empty": lambda v: ((C("type") == "d") & (C("entries") == 0)) | ((C("type") == "f") & (C("size") == 0)),
        **{k: lambda v, k=k: P.owner_may(k) for k in ("executable", "readable", "writable")},
        "true": lambda v: F.lit(True), "false": lambda v: F.lit(False),
        **{k: lambda v, c=c: P.compare(C(c), v) for k, c in (("gid", "gid"), ("uid", "uid"), ("links", "nlink"))},
        "inum": lambda v: C("inode") == v.lstrip("+-") if v[0] not in "+-" else P.compare(C("inode").try_cast("long"), v),
        "size": P.size_is,
        "group": lambda v: F.coalesce("group", C("gid").cast("string")) == v, "user": lambda v: F.coalesce("user", C("uid").cast("string")) == v,
        "name": lambda v: _any(v, P.name_is), "iname": lambda v: _any(v, P.iname_is),
        "path": lambda v: _any(v, lambda g: C("path").rlike(glob_to_regex(g))),
        "regex": lambda v: _any(v, lambda r: C("path").rlike(r)), "iregex": lambda v: _any(v, lambda r: C("path").rlike("(?i)" + r)),
        "lname": lambda v: (C("type") == "l") & _any(v, P.name_is),
        "perm": P.perm, "samefile": lambda v: C("inode") == str(v), "type": lambda v: C("type").isin(*(v if isinstance(v, (list, tuple)) else v.split(","))),
    }
    out = F.lit(True)
    for k, v in args.items():
        if k not in rules:
            raise ValueError(f"find: {k!r}")
        if v is not None and v is not False:
            out = out & rules[k](v)
    return out


def find(rows: DataFrame, *, now: int = 0, mindepth: int = 0, maxdepth: int | None = None, printf: str | None = None, ls: bool = False, largest: bool = False, smallest: bool = False, num_results: int | None = None, **args) -> DataFrame:
    """find over ``listing``: (path), or (value) of ``printf``, or the columns of a long listing.

    Depth counts from the start, whose own is 0; entries lie one below their directory.  ``largest`` and ``smallest``
    order by size, then path; without them paths are in no order.
    """
    depth = C("level") + F.when(C("type") == "d", 0).otherwise(1)
    out = rows.where(depth >= mindepth) if mindepth else rows
    out = out if maxdepth is None else out.where(depth <= maxdepth)
    out = out.where(conditions(now, **args))
    if largest or smallest:
        out = out.orderBy(F.desc("size") if largest else F.asc("size"), "path")
    if num_results is not None:
        out = out.limit(num_results)
    if ls:
        return out.select("inode", "blocks", modetotxt(C("mode")).alias("permissions"), "nlink", F.coalesce("user", C("uid").cast("string")).alias("owner"), F.coalesce("group", C("gid").cast("string")).alias("group"), "size", "mtime", "path")
    return out.select("path") if printf is None else out.select(formats.find_printf(printf).alias("value"))


def ls(rows: DataFrame, *, directory: str = "", now: int = 0, all: bool = False, almost_all: bool = False, ignore_backups: bool = False, sort: str = "name", reverse: bool = False, recursive: bool = False, long: bool = False, human_readable: bool = False, block_size: str | None = None, inode: bool = False, size: bool = False, time_style: str = "locale") -> DataFrame:
    """ls of a directory, or of all below it: ``path, name``, and with ``long`` the columns of a long listing.

    Names that start with a dot are hidden unless ``all`` or ``almost_all``; ``ignore_backups`` drops names that end in
    ~.  ``sort``: name (letter case aside), size (largest first), mtime (latest first) or none; ties go by name.
    """
    inside = F.substring("path", 1, F.length("path") - F.length("name") - 1)
    here = rows.where(C("path") != "")
    here = here.where((inside == directory) | inside.startswith(directory + "/") if directory else F.lit(True)) if recursive else here.where(inside == directory)
    if not (all or almost_all):
        here = here.where(~C("name").startswith("."))
    if ignore_backups:
        here = here.where(~C("name").endswith("~"))
    keys = {"name": [(F.lower("name"), True), (C("name"), True)], "size": [(C("size"), False), (C("name"), True)], "mtime": [(C("mtime"), False), (C("name"), True)], "none": []}[sort]
    order = ([inside] if recursive and keys else []) + [k.asc() if up != reverse else k.desc() for k, up in keys]
    here = here.orderBy(*order) if order else here
    shown = human_readable_size(C("size")) if human_readable else blocksize(C("size"), block_size) if block_size else C("size").cast("string")
    cols = [C("inode")] * inode + [C("blocks")] * (size and not long)
    if long:
        cols += [C("blocks")] * size + [modetotxt(C("mode")).alias("permissions"), C("nlink"), F.coalesce("user", C("uid").cast("string")).alias("owner"), F.coalesce("group", C("gid").cast("string")).alias("grp"), shown.alias("size"), formats.time_style(C("mtime"), time_style, now).alias("time"), C("linkname")]
    return here.select("path", "name", *cols)


def stat(rows: DataFrame, fmt: str | None = None, *, printf: str | None = None, terse: bool = False) -> DataFrame:
    """(path, value) of stat's default text, its ``--format``, its ``--printf`` (with escapes) or its terse line."""
    if terse:
        fmt = " ".join(f"%{c}" for c in "nsbfugDihtTXYZWo")
    value = formats.stat_format(printf, True) if printf is not None else formats.stat_format(fmt if fmt is not None else formats.STAT_DEFAULT)
    return rows.select("path", value.alias("value"))


def du(entries: DataFrame, dirs: DataFrame, *, directory: str = "", summarize: bool = False, separate_dirs: bool = False, apparent_size: bool = False, inodes: bool = False, block_size: str | None = None, human_readable: bool = False, total: bool = False, max_depth: int | None = None) -> DataFrame:
    """(used, path) of a directory and those below it: bytes of blocks, apparent bytes or numbers of inodes.

    ``separate_dirs`` leaves subdirectories out; ``summarize`` gives the directory alone; ``total`` adds a row "total".
    The subtree is cut out before anything is added up.
    """
    inside = lambda c: (F.col(c) == directory) | F.col(c).startswith(directory + "/") if directory else F.lit(True)
    mine = dirs.where(inside("path"))
    summary = M.dir_summary(entries.join(mine.select(C("inode").alias("pinode")), "pinode", "left_semi"), mine)
    whole = summary.withColumn("totsubdirs", F.lit(0).cast("long")) if separate_dirs else M.tree_summary(summary)
    whole = whole.where(inside("path"))
    if summarize:
        whole = whole.where(C("path") == directory)
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    if max_depth is not None:
        whole = whole.where(depth(C("path")) - depth(F.lit(directory)) <= max_depth)
    used = C("totfiles") + C("totlinks") + C("totsubdirs") + 1 if inodes else C("totsize") if apparent_size else C("totblocks") * 512
    rows = whole.select(used.alias("bytes"), "path")
    if total:
        rows = rows.unionByName(whole.where(C("path") == directory).select(used.alias("bytes"), F.lit("total").alias("path")))
    shown = C("bytes").cast("string") if inodes else human_readable_size(C("bytes")) if human_readable else blocksize(C("bytes"), block_size) if block_size else C("bytes").cast("string")
    return rows.select(shown.alias("used"), "path")


def getfattr(rows: DataFrame, xattrs: DataFrame, *, name: str | None = None, pattern: str = "^user\\.", directory: str = "", recursive: bool = False, types: str = "dfl") -> DataFrame:
    """(path, name, value): attributes of one exact name, or of names that match a pattern, of a path or all below it."""
    at = (C("path") == directory) | ((C("path").startswith(directory + "/") if directory else F.lit(True)) if recursive else F.lit(False))
    want = C("name") == name if name is not None else C("name").rlike(pattern)
    return rows.where(at & C("type").isin(*types)).select("inode", "path").join(xattrs.where(want), "inode").select("path", "name", "value")
