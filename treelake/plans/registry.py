"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hist as H
from ..functions import scalar as S
from ..operators import analyses as A
from ..operators import find as P
from ..operators import summary as M
from ..sources import trace
from ..sources.star import NOW, ORACLE_CTE, Index, load, table
from ..streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, cte: str = "", name: str | None = None):
    """Register a function of (index, spark, sf_dir) under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(load(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE[key] = f"WITH {ORACLE_CTE}{', ' + cte if cte else ''} {sql}"
        return f

    return add


FIND = ["inode", "name", "size"]


def finder(name: str, where: Callable[[], F.Column], sql: str) -> None:
    query(f"SELECT inode, name, size FROM entries WHERE {sql}", name=name)(lambda x, s, d: x.entries.where(where()).select(*FIND))


C = F.col
finder("find_name_glob", lambda: P.name_is("p1*_[1-3].?", "*_6"), r"regexp_matches(name, '^p1.*_[1-3]\..$') OR name LIKE '%\_6' ESCAPE '\'")
finder("find_iname_regex", lambda: P.iname_is("P2*.R"), r"regexp_matches(name, '(?i)^p2.*\.r$')")
finder("find_regex", lambda: C("name").rlike(r"_[45]\.(a|n)"), r"regexp_matches(name, '_[45]\.(a|n)')")
finder("find_size", lambda: P.size_is("+512k"), "ceil(size / 1024.0) > 512")
finder("find_size_blocks", lambda: P.size_is("-40"), "ceil(size / 512.0) < 40")
finder("find_mtime", lambda: P.compare(P.days_since("mtime", NOW), "+1500"), f"({NOW} - mtime) / 86400.0 > 1500")
finder("find_mmin", lambda: P.compare(P.minutes_since("mtime", NOW), "-900000"), f"({NOW} - mtime) / 60.0 < 900000")
finder("find_amin", lambda: P.compare(P.minutes_since("atime", NOW), "+2000000"), f"({NOW} - atime) / 60.0 > 2000000")
finder("find_ctime", lambda: P.compare(P.days_since("ctime", NOW), "-1200"), f"({NOW} - ctime) / 86400.0 < 1200")
finder("find_newer", lambda: C("mtime") > 900_000_000, "mtime > 900000000")
finder("find_empty", lambda: (C("type") == "f") & (C("size") == 0), "type = 'f' AND size = 0")
finder("find_perm_exact", lambda: P.perm("644"), "(mode & 4095) = 420")
finder("find_perm_all", lambda: P.perm("-604"), "(mode & 388) = 388")
finder("find_perm_any", lambda: P.perm("/044"), "(mode & 36) <> 0")
finder("find_owner_bits", lambda: P.owner_may("readable") & ~P.owner_may("executable") & P.owner_may("writable"), "(mode & 256) <> 0 AND (mode & 64) = 0 AND (mode & 128) <> 0")
finder("find_type", lambda: C("type").isin("l"), "type = 'l'")
finder("find_uid_gid", lambda: P.compare(C("uid"), "-100") & P.compare(C("gid"), "+10"), "uid < 100 AND gid > 10")
finder("find_lname", lambda: (C("type") == "l") & P.name_is("p3*"), "type = 'l' AND name LIKE 'p3%'")
finder("find_true_false", lambda: F.lit(True) & ~F.lit(False) & (C("size") > 3_000_000_000), "size > 3000000000")
finder("find_samefile", lambda: C("inode").startswith("1-"), "inode LIKE '1-%'")


@query("SELECT inode, path FROM dirs WHERE level BETWEEN 1 AND 3")
def find_levels(x: Index, s, d):
    return P.levels(x.dirs, 1, 3).select("inode", "path")


@query("SELECT e.inode, concat(d.path, '/', name) AS path FROM entries e JOIN dirs d ON e.pinode = d.inode WHERE regexp_matches(d.path, '^r1/n.*/c1.*$')")
def find_path(x: Index, s, d):
    dirs = x.dirs.where(C("path").rlike(S.glob_to_regex("r1/n*/c1*")))
    return x.entries.join(dirs.select(C("inode").alias("pinode"), "path"), "pinode").select("inode", S.rpath(C("path"), C("name")).alias("path"))


@query("SELECT inode, path FROM dirs WHERE NOT list_has_any(string_split(path, '/'), ['r2', 'n5', 'c7'])")
def skip_names(x: Index, s, d):
    return P.skip_names(x.dirs, ["r2", "n5", "c7"]).select("inode", "path")


@query("SELECT inode, path FROM dirs WHERE path = 'r3' OR path LIKE 'r3/%' OR path = 'r1/n1' OR path LIKE 'r1/n1/%'")
def path_list(x: Index, s, d):
    return P.path_list(x.dirs, ["r3", "r1/n1"]).select("inode", "path")


@query("SELECT inode, path FROM dirs WHERE list_has_any(string_split(path, '/'), ['n3', 'n4', 'c11'])")
def dir_match_uid(x: Index, s, d):
    return P.owner_match(x.dirs, C("inode").isin("n3", "n4", "c11")).select("inode", "path")


def scalar(name: str, expr: Callable[[], F.Column], sql: str) -> None:
    query(f"SELECT inode, {sql} AS v FROM entries", name=name)(lambda x, s, d: x.entries.select("inode", expr().alias("v")))


def _cat(x: str, steps: list[tuple[int, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN '{v}'" for b, v in steps) + f" ELSE '{last}' END"


_age = [(1, "Zero"), (60, "Secs"), (3600, "Mins"), (86400, "Hrs"), (604800, "Days"), (2592000, "Wks"), (31536000, "Mos"), (315360000, "Yrs")]
scalar("bytecat", lambda: S.bytecat(C("size")), _cat("size", [(1, "Zero"), *[(1024 ** (k + 1), v) for k, v in enumerate("BKMGTP")]], "E"))
scalar("intcat", lambda: S.intcat(C("size")), _cat("size", [(1, "Zero"), *[(1000 ** (k + 1), v) for k, v in enumerate("OKMBTq")]], "Q"))
scalar("agecat", lambda: S.agecat(C("mtime"), NOW), _cat(f"({NOW} - mtime)", _age, "Decs"))
scalar("epochtoage", lambda: S.epochtoage(C("mtime"), NOW, "w"), f"CAST(floor(({NOW} - mtime) / 604800.0) AS BIGINT)")
scalar("blocksize", lambda: S.blocksize(C("size"), "KiB"), "concat(CAST(ceil(size / 1024.0) AS BIGINT), 'KiB')")
scalar("blocksize_counted", lambda: S.blocksize(C("size"), "4KB"), "CAST(CAST(ceil(size / 4000.0) AS BIGINT) AS VARCHAR)")
scalar("human_readable_size", lambda: S.human_readable_size(C("size")), "CASE WHEN size < 1024 THEN printf('%.1f', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN concat(printf('%.1f', round_even(size / 1024.0, 1)), 'K') WHEN size < 1073741824 THEN concat(printf('%.1f', round_even(size / 1048576.0, 1)), 'M') ELSE concat(printf('%.1f', round_even(size / 1073741824.0, 1)), 'G') END")
scalar("ext", lambda: S.ext(C("name")), r"nullif(regexp_extract(name, '\.([^.]+)$', 1), '')")
scalar("rpad", lambda: S.rpad(C("name"), 10), "CASE WHEN length(name) >= 10 THEN name ELSE rpad(name, 10, ' ') END")
scalar("modetotxt", lambda: S.modetotxt(C("mode")), "concat(CASE WHEN (mode & 61440) = 40960 THEN 'l' ELSE '-' END, CASE WHEN (mode & 511) = 420 THEN 'rw-r--r--' ELSE 'rw-------' END)")
scalar("strftime", lambda: S.strftime("%Y-%m-%d %H:%M", C("mtime")), "strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M')")
scalar("find_printf", lambda: F.concat_ws(" ", F.lpad(C("size").cast("string"), 12, " "), "type", F.conv(C("mode").bitwiseAND(F.lit(511)).cast("string"), 10, 8), "name"), "concat_ws(' ', lpad(CAST(size AS VARCHAR), 12, ' '), type, CASE WHEN (mode & 511) = 420 THEN '644' ELSE '600' END, name)")
scalar("stat_format", lambda: F.concat_ws("|", "name", C("size").cast("string"), F.floor((C("size") + 511) / 512).cast("string"), S.modetotxt(C("mode")), C("mtime").cast("string")), "concat_ws('|', name, size, CAST(floor((size + 511) / 512.0) AS BIGINT), concat(CASE WHEN (mode & 61440) = 40960 THEN 'l' ELSE '-' END, CASE WHEN (mode & 511) = 420 THEN 'rw-r--r--' ELSE 'rw-------' END), mtime)")


@query("SELECT page_id, CASE WHEN regexp_replace(url, '/+$', '') = '' THEN '/' ELSE regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') END AS base FROM pages")
def basename(x: Index, s, d):
    return table(s, d, "pages").select("page_id", S.basename(C("url")).alias("base"))


@query("SELECT e.inode, concat(d.path, '/', e.name) AS rpath, concat('/mnt/', d.path, '/', e.name) AS spath FROM entries e JOIN dirs d ON e.pinode = d.inode")
def rpath_spath(x: Index, s, d):
    j = x.entries.join(x.dirs.select(C("inode").alias("pinode"), "path"), "pinode")
    return j.select("inode", S.rpath(C("path"), C("name")).alias("rpath"), S.spath("/mnt", C("path"), C("name")).alias("spath"))


@query("SELECT e.inode, coalesce(c_name, CAST(uid AS VARCHAR)) AS usr, coalesce(n_name, CAST(gid AS VARCHAR)) AS grp FROM entries e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON uid = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON gid = n_nationkey")
def uidtouser_gidtogroup(x: Index, s, d):
    users = table(s, d, "customer").where("c_custkey % 5 <> 0").select(C("c_custkey").alias("uid"), "c_name")
    groups = table(s, d, "nation").where("n_nationkey % 4 <> 0").select(C("n_nationkey").cast("long").alias("gid"), "n_name")
    j = x.entries.select("inode", "uid", "gid").join(users, "uid", "left").join(F.broadcast(groups), "gid", "left")
    return j.select("inode", F.coalesce("c_name", C("uid").cast("string")).alias("usr"), F.coalesce("n_name", C("gid").cast("string")).alias("grp"))


@query("SELECT d.inode, count(k.inode) AS subdirs FROM dirs d LEFT JOIN dirs k ON k.pinode = d.inode GROUP BY d.inode")
def subdirs(x: Index, s, d):
    kids = x.dirs.groupBy("pinode").agg(F.count(F.lit(1)).alias("subdirs")).withColumnRenamed("pinode", "inode")
    return x.dirs.select("inode").join(kids, "inode", "left").na.fill(0)


@query("SELECT e.inode, e.name, e.pinode, d.pinode AS ppinode, d.path, d.level FROM entries e JOIN dirs d ON e.pinode = d.inode")
def vrpentries(x: Index, s, d):
    return x.entries.select("inode", "name", "pinode").join(x.dirs.select(C("inode").alias("pinode"), C("pinode").alias("ppinode"), "path", "level"), "pinode")


@query("SELECT DISTINCT inode, name, pinode, ppinode, size FROM entries")
def pentries(x: Index, s, d):
    return x.entries.select("inode", "name", "pinode", "ppinode", "size").distinct()


@query("SELECT e.inode, e.name, a.name AS xattr_name, a.value AS xattr_value FROM entries e LEFT JOIN xattrs a ON e.inode = a.inode")
def xpentries(x: Index, s, d):
    return x.entries.select("inode", "name").join(x.xattrs.select("inode", C("name").alias("xattr_name"), C("value").alias("xattr_value")), "inode", "left")


@query("SELECT e.inode, e.name, a.value FROM entries e JOIN xattrs a ON e.inode = a.inode WHERE a.name = 'user.flag' AND a.value = 'R'")
def getfattr(x: Index, s, d):
    return x.entries.select("inode", C("name").alias("entry")).join(x.xattrs.where("name = 'user.flag' and value = 'R'"), "inode").select("inode", C("entry").alias("name"), "value")


@query("SELECT inode, name, value FROM xattrs UNION SELECT inode, name, value FROM xattrs WHERE value = 'O'")
def xattrs_union(x: Index, s, d):
    return x.xattrs.union(x.xattrs.where("value = 'O'")).distinct()


@query("SELECT 'a' AS host, inode, size FROM entries WHERE gid < 5 UNION ALL SELECT 'b', inode, size FROM entries WHERE gid < 10")
def roots_union_all(x: Index, s, d):
    part = lambda h, n: x.entries.where(C("gid") < n).select(F.lit(h).alias("host"), "inode", "size")
    return part("a", 5).unionByName(part("b", 10))


@query("SELECT DISTINCT uid FROM entries WHERE type = 'f'")
def distinct_uids(x: Index, s, d):
    return x.entries.where("type = 'f'").select("uid").distinct()


@query("SELECT e.inode, p_brand, p_type FROM entries e LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON partkey = p_partkey WHERE gid = 3")
def external_attach(x: Index, s, d):
    return _attached(x.entries.where("gid = 3"), s, d)


@query("SELECT e.inode, p_brand, p_type FROM entries e LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON partkey = p_partkey")
def external_attach_all(x: Index, s, d):
    return _attached(x.entries, s, d)


def _attached(entries: DataFrame, s, d) -> DataFrame:
    side = table(s, d, "part").where("p_size > 10").select(C("p_partkey").alias("partkey"), "p_brand", "p_type")
    return entries.select("inode", "partkey").join(side, "partkey", "left").drop("partkey")


_sum_sql = """count(*) FILTER (WHERE type = 'f') AS totfiles, count(*) FILTER (WHERE type = 'l') AS totlinks,
 min(size) FILTER (WHERE type = 'f') AS minsize, max(size) FILTER (WHERE type = 'f') AS maxsize, coalesce(CAST(sum(size) FILTER (WHERE type = 'f') AS BIGINT), 0) AS totsize,
 count(*) FILTER (WHERE type = 'f' AND size = 0) AS totzero, count(*) FILTER (WHERE type = 'f' AND size <= 1024) AS totltk, count(*) FILTER (WHERE type = 'f' AND size > 1024) AS totmtk,
 count(*) FILTER (WHERE type = 'f' AND size <= 1048576) AS totltm, count(*) FILTER (WHERE type = 'f' AND size > 1048576) AS totmtm,
 count(*) FILTER (WHERE type = 'f' AND size > 1073741824) AS totmtg, count(*) FILTER (WHERE type = 'f' AND size > 1099511627776) AS totmtt,
 min(CAST(floor((size + 511) / 512.0) AS BIGINT)) FILTER (WHERE type = 'f') AS minblocks, max(CAST(floor((size + 511) / 512.0) AS BIGINT)) FILTER (WHERE type = 'f') AS maxblocks,
 coalesce(CAST(sum(CAST(floor((size + 511) / 512.0) AS BIGINT)) FILTER (WHERE type = 'f') AS BIGINT), 0) AS totblocks, """ + ", ".join([f"min({c}) AS min{c}" for c in M.ANY] + [f"max({c}) AS max{c}" for c in M.ANY] + [f"coalesce(CAST(sum({c}) AS BIGINT), 0) AS tot{c}" for c in ("mtime", "ctime", "atime")])
_sum_cols = ["totfiles", "totlinks", "minsize", "maxsize", "totsize", "totzero", "totltk", "totmtk", "totltm", "totmtm", "totmtg", "totmtt", "minblocks", "maxblocks", "totblocks", *[f"min{c}" for c in M.ANY], *[f"max{c}" for c in M.ANY], "totmtime", "totctime", "totatime"]
_fill = lambda c, a="": f"coalesce({a}{c}, {M.LOW if c[:3] == 'min' else M.HIGH if c[:3] == 'max' else 0}) AS {c}"
_SUMMARY = f"per AS (SELECT pinode AS dir, {_sum_sql} FROM entries GROUP BY pinode), summary AS (SELECT d.inode, d.pinode, d.level, d.path, {', '.join(map(_fill, _sum_cols))} FROM dirs d LEFT JOIN per ON d.inode = per.dir)"
_tree_sums = ["totfiles", "totlinks", "totsize", "totzero", "totltk", "totmtk", "totltm", "totmtm", "totmtg", "totmtt", "totblocks"]
_tree_mins = ["minsize", "minuid", "mingid", "minmtime", "minctime", "minatime"]
_TREE = _SUMMARY + """, tree0 AS (SELECT a.path, count(*) - 1 AS totsubdirs, max(s.totfiles) AS maxsubdirfiles, max(s.totlinks) AS maxsubdirlinks, max(s.totsize) AS maxsubdirsize, """ + ", ".join([f"CAST(sum(s.{c}) AS BIGINT) AS {c}" for c in _tree_sums] + [f"min(s.{c}) FILTER (WHERE s.totfiles > 0) AS {c}" for c in _tree_mins] + [f"max(s.{c.replace('min', 'max')}) FILTER (WHERE s.totfiles > 0) AS {c.replace('min', 'max')}" for c in _tree_mins] + [f"coalesce(CAST(sum(s.{c}) FILTER (WHERE s.totfiles > 0) AS BIGINT), 0) AS {c}" for c in ("totmtime", "totctime", "totatime")]) + """
 FROM (SELECT unnest(list_transform(range(0, level + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path, inode FROM dirs) a JOIN summary s ON a.inode = s.inode GROUP BY a.path),
 tree AS (SELECT path, totsubdirs, maxsubdirfiles, maxsubdirlinks, maxsubdirsize, """ + ", ".join(map(_fill, [*_tree_sums, *_tree_mins, *[c.replace("min", "max") for c in _tree_mins], "totmtime", "totctime", "totatime"])) + " FROM tree0)"


@query("SELECT * FROM summary", _SUMMARY)
def dir_summary(x: Index, s, d):
    return M.dir_summary(x.entries, x.dirs)


@query("SELECT inode, minsize, maxsize, totsize FROM summary WHERE totfiles + totlinks = 0", _SUMMARY)
def empty_dir_identity(x: Index, s, d):
    return M.dir_summary(x.entries, x.dirs).where("totfiles + totlinks = 0").select("inode", "minsize", "maxsize", "totsize")


@query("SELECT * FROM tree", _TREE)
def treesummary_all(x: Index, s, d):
    return M.tree_summary(M.dir_summary(x.entries, x.dirs))


@query("SELECT * FROM tree WHERE path = ''", _TREE)
def treesummary_root(x: Index, s, d):
    return M.one_tree_summary(M.dir_summary(x.entries, x.dirs))


for _k in ("uid", "gid"):
    query(f"SELECT inode, {_k}, {', '.join(map(_fill, _sum_cols))} FROM (SELECT pinode AS inode, {_k}, {_sum_sql} FROM entries GROUP BY pinode, {_k})", name=f"{_k}_summary")(lambda x, s, d, k=_k: M.dir_summary(x.entries, x.dirs, [k]))
    query(f"SELECT {_k}, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM entries WHERE type = 'f' GROUP BY {_k}", name=("user" if _k == "uid" else "group") + "_space_hog")(
        lambda x, s, d, k=_k: x.entries.where("type = 'f'").groupBy(k).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), k)
    )
    query(f"SELECT {_k}, CAST(sum(totfiles) AS BIGINT) AS files, CAST(sum(totsize) AS BIGINT) AS bytes FROM (SELECT pinode, {_k}, {_sum_sql} FROM entries GROUP BY pinode, {_k}) GROUP BY {_k}", name=("user" if _k == "uid" else "group") + "_space_hog_via_summary")(
        lambda x, s, d, k=_k: M.dir_summary(x.entries, x.dirs, [k]).groupBy(k).agg(F.sum("totfiles").alias("files"), F.sum("totsize").alias("bytes"))
    )
    query(f"SELECT * FROM (SELECT {_k}, inode, name, size, CAST(row_number() OVER (PARTITION BY {_k} ORDER BY size DESC, name, inode) AS INTEGER) AS rank FROM entries WHERE type = 'f') WHERE rank <= 5", name=f"{_k}_size_topn")(
        lambda x, s, d, k=_k: A.top_by_group(x.entries.where("type = 'f'").select(k, "inode", "name", "size"), k, 5)
    )
    for _t, _n in (("f", "file"), ("l", "link")):
        query(f"SELECT pinode, count(DISTINCT {_k}) AS n FROM entries WHERE type = '{_t}' GROUP BY pinode", name=f"unique_{_n}_{_k}_count")(
            lambda x, s, d, k=_k, t=_t: x.entries.where(C("type") == t).groupBy("pinode").agg(F.count_distinct(k).alias("n"))
        )


@query("SELECT inode, name, size FROM entries ORDER BY size DESC, name, inode LIMIT 50")
def largest(x: Index, s, d):
    return x.entries.select(*FIND).orderBy(F.desc("size"), "name", "inode").limit(50)


@query("SELECT inode, name, size FROM entries WHERE size > 0 ORDER BY size, name, inode LIMIT 50")
def smallest(x: Index, s, d):
    return x.entries.where("size > 0").select(*FIND).orderBy("size", "name", "inode").limit(50)


@query("SELECT inode, name, size, mtime FROM entries WHERE size > 1000000 AND mtime < 850000000 AND type = 'f'")
def old_big_files(x: Index, s, d):
    return x.entries.where("size > 1000000 and mtime < 850000000 and type = 'f'").select("inode", "name", "size", "mtime").orderBy("mtime", F.desc("size"), "inode")


@query(r"SELECT inode, name, lower(name) AS k FROM entries WHERE gid = 1 AND name NOT LIKE '.%' AND name NOT LIKE '%~'")
def ls_sorted(x: Index, s, d):
    return _listed(x.entries.where("gid = 1"))


@query(r"SELECT inode, name, lower(name) AS k FROM entries WHERE name NOT LIKE '.%' AND name NOT LIKE '%~'")
def ls_sorted_all(x: Index, s, d):
    return _listed(x.entries)


def _listed(entries: DataFrame) -> DataFrame:
    return entries.where("name not like '.%' and name not like '%~'").select("inode", "name", F.lower("name").alias("k")).orderBy("k", "inode")


def stat(name: str, f: Callable, sql: str, cte: str = "") -> None:
    query(sql, cte, name=name)(lambda x, s, d: f(x))


def _count(x: Index, t: str):
    e = x.entries.where(C("type") == t).select(C("pinode").alias("inode"), C("inode").alias("e"))
    return x.dirs.select("inode").join(e, "inode", "left").groupBy("inode").agg(F.count("e").alias("n"))


def _leaves(x: Index):
    return x.dirs.join(x.dirs.select(C("pinode").alias("inode")), "inode", "left_anti")


_LEAF = "leaf AS (SELECT * FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM dirs k WHERE k.pinode = d.inode))"


def _per_leaf(x: Index):
    e = x.entries.select(C("pinode").alias("inode"), "type", "size")
    return _leaves(x).select("inode").join(e, "inode", "left").groupBy("inode").agg(F.count_if(C("type") == "f").alias("files"), F.count_if(C("type") == "l").alias("links"), F.coalesce(F.sum(F.when(C("type") == "f", C("size"))), F.lit(0)).alias("bytes"))


def _median_leaf(x: Index) -> DataFrame:
    long = _per_leaf(x).select(F.stack(F.lit(3), F.lit("files"), "files", F.lit("links"), "links", F.lit("bytes"), "bytes").alias("c", "v"))
    m = A.medians(long, ["c"], "v")
    return m.agg(*[F.max(F.when(C("c") == c, C("median"))).alias(c) for c in ("files", "links", "bytes")])


_PER_LEAF = _LEAF + ", perleaf AS (SELECT leaf.inode, count(*) FILTER (WHERE type = 'f') AS files, count(*) FILTER (WHERE type = 'l') AS links, coalesce(CAST(sum(size) FILTER (WHERE type = 'f') AS BIGINT), 0) AS bytes FROM leaf LEFT JOIN entries e ON e.pinode = leaf.inode GROUP BY leaf.inode)"
stat("depth", lambda x: x.dirs.select("inode", F.when(C("path") == "", 0).otherwise(F.size(F.split("path", "/"))).alias("depth")), "SELECT inode, CAST(CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS INTEGER) AS depth FROM dirs")
stat("filesize", lambda x: x.dirs.select("inode").join(x.entries.where("type = 'f'").groupBy(C("pinode").alias("inode")).agg(F.sum("size").alias("bytes")), "inode", "left").na.fill(0), "SELECT d.inode, coalesce(CAST(sum(size) AS BIGINT), 0) AS bytes FROM dirs d LEFT JOIN entries e ON e.pinode = d.inode AND type = 'f' GROUP BY d.inode")
for _t, _n in (("f", "file"), ("l", "link")):
    stat(f"{_n}count_left", lambda x, t=_t: _count(x, t), f"SELECT d.inode, count(e.inode) AS n FROM dirs d LEFT JOIN entries e ON e.pinode = d.inode AND type = '{_t}' GROUP BY d.inode")
    stat(f"total_{_n}count", lambda x, t=_t: x.entries.where(C("type") == t).groupBy("uid").agg(F.count(F.lit(1)).alias("n")), f"SELECT uid, count(*) AS n FROM entries WHERE type = '{_t}' GROUP BY uid")
    stat(f"{_n}s_per_level", lambda x, t=_t: x.placed.where(C("type") == t).groupBy(C("dlevel").alias("level"), "uid").agg(F.count(F.lit(1)).alias("n")), f"SELECT level, uid, count(*) AS n FROM entries e JOIN dirs d ON e.pinode = d.inode WHERE type = '{_t}' GROUP BY level, uid")
    stat(f"leaf_{_n}s", lambda x, n=_n: _per_leaf(x).select("inode", C(f"{n}s").alias("n")), f"SELECT inode, {_n}s AS n FROM perleaf", _PER_LEAF)
    stat(f"total_leaf_{_n}s", lambda x, n=_n: _per_leaf(x).agg(F.sum(f"{n}s").alias("n")), f"SELECT CAST(sum({_n}s) AS BIGINT) AS n FROM perleaf", _PER_LEAF)
stat("total_filesize", lambda x: x.entries.where("type = 'f'").groupBy("uid").agg(F.sum("size").alias("bytes")), "SELECT uid, CAST(sum(size) AS BIGINT) AS bytes FROM entries WHERE type = 'f' GROUP BY uid")
stat("dircount", lambda x: x.dirs.groupBy("pinode").agg(F.count(F.lit(1)).alias("n")), "SELECT pinode, count(*) AS n FROM dirs GROUP BY pinode")
stat("total_dircount", lambda x: x.dirs.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM dirs")
stat("dirs_per_level", lambda x: x.dirs.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "SELECT level, count(*) AS n FROM dirs GROUP BY level")
stat("leaf_dirs", lambda x: _leaves(x).select("inode", "path"), "SELECT inode, path FROM leaf", _LEAF)
stat("leaf_depth", lambda x: _leaves(x).groupBy("level").agg(F.count(F.lit(1)).alias("n")), "SELECT level, count(*) AS n FROM leaf GROUP BY level", _LEAF)
stat("average_leaf", lambda x: _per_leaf(x).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("files", "links", "bytes")]), "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("files", "links", "bytes")) + " FROM perleaf", _PER_LEAF)
stat("median_leaf", lambda x: _median_leaf(x), "SELECT " + ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in ("files", "links", "bytes")) + " FROM perleaf", _PER_LEAF)
stat("extensions", lambda x: x.entries.groupBy(S.ext(C("name")).alias("ext")).agg(F.count(F.lit(1)).alias("n")), r"SELECT nullif(regexp_extract(name, '\.([^.]+)$', 1), '') AS ext, count(*) AS n FROM entries GROUP BY 1")
stat("duplicate_names", lambda x: x.entries.join(x.entries.groupBy("name", "type", "size").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), ["name", "type", "size"]).select("inode", "name", "size", "copies"), "SELECT inode, name, size, copies FROM (SELECT *, count(*) OVER (PARTITION BY name, type, size) AS copies FROM entries) WHERE copies > 1")
for _b, _n in ((2, 60), (1024, 6)):
    _case = "CASE WHEN size < 1 THEN -1 " + " ".join(f"WHEN size < {_b ** (k + 1)} THEN {k}" for k in range(_n) if _b ** (k + 1) < 1 << 63) + f" ELSE {_n} END"
    stat(f"filesize_log{_b}_bins", lambda x, b=_b, n=_n: x.entries.where("type = 'f'").groupBy(H.log_bucket(C("size"), b, n).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_case} AS bin, count(*) AS n FROM entries WHERE type = 'f' GROUP BY 1")
    stat(f"dirfilecount_log{_b}_bins", lambda x, b=_b, n=_n: _count(x, "f").groupBy(H.log_bucket(C("n"), b, n).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f"SELECT {_case.replace('size', 'c')} AS bin, count(*) AS n FROM (SELECT count(e.inode) AS c FROM dirs d LEFT JOIN entries e ON e.pinode = d.inode AND type = 'f' GROUP BY d.inode) GROUP BY 1")
    _hist = f"SELECT gid, concat('{_b};{_n};', count(*) FILTER (WHERE b = -1), ';', count(*) FILTER (WHERE b = {_n}), ';', coalesce((SELECT string_agg(concat(k, ':', c, ';'), '' ORDER BY k) FROM (SELECT b2.b AS k, count(*) AS c FROM hb b2 WHERE b2.gid = hb.gid AND b2.b >= 0 AND b2.b < {_n} GROUP BY b2.b)), '')) AS hist FROM hb GROUP BY gid"
    stat(f"log_hist_{_b}", lambda x, b=_b, n=_n: H.log_text(H.buckets(x.entries, ["gid"], H.log_bucket(C("size"), b, n)), ["gid"], b, n), _hist, f"hb AS (SELECT gid, {_case} AS b FROM entries)")
    stat(f"log_hist_combine_{_b}", lambda x, b=_b, n=_n: H.log_text(H.merge(H.buckets(x.entries, ["gid", "uid"], H.log_bucket(C("size"), b, n)), ["gid"]), ["gid"], b, n), _hist, f"hb AS (SELECT gid, {_case} AS b FROM entries)")
_MODE = "SELECT gid, string_agg(concat(o, ':', c, ';'), '' ORDER BY o) AS hist FROM (SELECT gid, CASE WHEN (mode & 511) = 420 THEN '644' ELSE '600' END AS o, count(*) AS c FROM entries GROUP BY 1, 2) GROUP BY gid"
_TIME = "SELECT gid, concat('%d;', string_agg(concat(b, ':', c, ';'), '' ORDER BY b)) AS hist FROM (SELECT gid, CASE " % NOW + " ".join(f"WHEN {NOW} - mtime < {a} THEN {a}" for a in H.AGES) + " ELSE 630720001 END AS b, count(*) AS c FROM entries GROUP BY 1, 2) GROUP BY gid"
_CAT = "SELECT user_id % 10 AS g, concat(count(*), ';', string_agg(concat(length(event_type), ':', event_type, ':', c, ';'), '' ORDER BY event_type)) AS hist FROM (SELECT user_id % 10 AS user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1"
_mode = lambda: C("mode").bitwiseAND(F.lit(511))
stat("mode_hist", lambda x: H.mode_text(H.buckets(x.entries, ["gid"], _mode()), ["gid"]), _MODE)
stat("mode_hist_combine", lambda x: H.mode_text(H.merge(H.buckets(x.entries, ["gid", "uid"], _mode()), ["gid"]), ["gid"]), _MODE)
stat("time_hist", lambda x: H.time_text(H.buckets(x.entries, ["gid"], H.time_bucket(C("mtime"), NOW)), ["gid"], NOW), _TIME)
stat("time_hist_combine", lambda x: H.time_text(H.merge(H.buckets(x.entries, ["gid", "uid"], H.time_bucket(C("mtime"), NOW)), ["gid"]), ["gid"], NOW), _TIME)
stat("extension_hist", lambda x: H.category_text(H.buckets(x.entries, ["gid"], F.coalesce(S.ext(C("name")), F.lit("no-ext"))), ["gid"]), r"SELECT gid, concat(count(*), ';', string_agg(concat(length(x), ':', x, ':', c, ';'), '' ORDER BY x)) AS hist FROM (SELECT gid, coalesce(nullif(regexp_extract(name, '\.([^.]+)$', 1), ''), 'no-ext') AS x, count(*) AS c FROM entries GROUP BY 1, 2) GROUP BY gid")
for _c in ("atime", "mtime", "ctime"):
    _ages = [*[(a, a) for a in H.AGES]]
    stat(f"file_age_{_c}", lambda x, c=_c: x.entries.where("type = 'f'").groupBy("uid", H.time_bucket(C(c), NOW).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "SELECT uid, CASE " + " ".join(f"WHEN {NOW} - {_c} < {a} THEN {a}" for a in H.AGES) + " ELSE 630720001 END AS bin, count(*) AS n FROM entries WHERE type = 'f' GROUP BY 1, 2")


@query(_CAT)
def category_hist(x: Index, s, d):
    return H.category_text(H.buckets(table(s, d, "events").withColumn("g", C("user_id") % 10), ["g"], C("event_type")), ["g"])


@query(_CAT)
def category_hist_combine(x: Index, s, d):
    return H.category_text(H.merge(H.buckets(table(s, d, "events").withColumn("g", C("user_id") % 10), ["g", "user_id"], C("event_type")), ["g"]), ["g"])


@query("SELECT g, CASE WHEN count(*) = 1 THEN concat(length(min(t)), ':', min(t), ':', min(c), ';') END AS hist FROM (SELECT *, max(c) OVER (PARTITION BY g) AS m FROM (SELECT user_id % 50 AS g, event_type AS t, count(*) AS c FROM events GROUP BY 1, 2)) WHERE c = m GROUP BY g")
def mode_count(x: Index, s, d):
    return H.mode_count(H.buckets(table(s, d, "events").withColumn("g", C("user_id") % 50), ["g"], C("event_type")), ["g"])


_whole = "CAST(floor(value * 100) AS BIGINT)"


@query(f"SELECT user_id, round(stddev_samp({_whole}), 6) AS s, round(CASE WHEN count(*) >= 2 THEN stddev_pop({_whole}) END, 6) AS p, CAST(median({_whole}) AS DOUBLE) AS med FROM events GROUP BY user_id")
def stdev_median(x: Index, s, d):
    v = F.floor(C("value") * 100).cast("long")
    return table(s, d, "events").groupBy("user_id").agg(F.round(S.stdevs(v), 6).alias("s"), F.round(S.stdevp(v), 6).alias("p"), F.percentile(v, 0.5).alias("med"))


@query("SELECT gid, round(sqrt((count(*) * CAST(sum(line * line) AS DOUBLE) - CAST(sum(line) AS DOUBLE) * sum(line)) / (CAST(count(*) AS DOUBLE) * (count(*) - 1))), 6) AS s FROM entries GROUP BY gid")
def stdev_from_parts(x: Index, s, d):
    e = x.entries.groupBy("gid").agg(F.sum(C("line") * C("line")).alias("q"), F.sum("line").alias("t"), F.count(F.lit(1)).alias("n"))
    return e.select("gid", F.round(S.stdev_from_parts(C("q"), C("t"), C("n"), True), 6).alias("s"))


@query("SELECT path, totsize AS apparent, totblocks AS blocks, totfiles + totlinks + totsubdirs AS inodes FROM tree", _TREE)
def du(x: Index, s, d):
    return M.tree_summary(M.dir_summary(x.entries, x.dirs)).select("path", C("totsize").alias("apparent"), C("totblocks").alias("blocks"), (C("totfiles") + C("totlinks") + C("totsubdirs")).alias("inodes"))


@query("SELECT path, totsize AS apparent, totblocks AS blocks FROM summary", _SUMMARY)
def du_separate(x: Index, s, d):
    return M.dir_summary(x.entries, x.dirs).select("path", C("totsize").alias("apparent"), C("totblocks").alias("blocks"))


@query("SELECT e.inode, e.size FROM entries e WHERE e.pinode IN (SELECT inode FROM summary WHERE maxsize > 50000000) AND e.size > 50000000", _SUMMARY)
def staged_gate(x: Index, s, d):
    gate = M.dir_summary(x.entries, x.dirs).where("maxsize > 50000000 and totfiles + totlinks > 0").select(C("inode").alias("pinode"))
    return x.entries.where("size > 50000000").join(gate, "pinode", "left_semi").select("inode", "size")


@query("SELECT gid, CAST(sum(c) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS big FROM (SELECT pinode, gid, count(*) AS c, max(size) AS m FROM entries GROUP BY pinode, gid) GROUP BY gid")
def staged_agg(x: Index, s, d):
    return x.entries.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("big"))


_SNAP = "tree2 AS (SELECT inode, CASE WHEN CAST(substr(inode, 2) AS BIGINT) % 83 = 0 THEN 'root' ELSE pinode END AS pinode, path, CASE WHEN CAST(substr(inode, 2) AS BIGINT) % 79 = 0 THEN 1 ELSE 0 END AS suspect FROM dirs WHERE level = 4 AND CAST(substr(inode, 2) AS BIGINT) % 97 <> 0 UNION ALL SELECT concat('x', substr(inode, 2)), pinode, concat(path, 'x'), 0 FROM dirs WHERE level = 4 AND CAST(substr(inode, 2) AS BIGINT) % 89 = 0), idx AS (SELECT * FROM dirs WHERE level = 4)"


def _snapshots(x: Index) -> tuple[DataFrame, DataFrame]:
    idx = x.dirs.where("level = 4")
    k = F.substring("inode", 2, 30).try_cast("long")
    tree = idx.where(k % 97 != 0).select("inode", F.when(k % 83 == 0, "root").otherwise(C("pinode")).alias("pinode"), "path", F.when(k % 79 == 0, 1).otherwise(0).alias("suspect"))
    made = idx.where(k % 89 == 0).select(F.concat(F.lit("x"), F.substring("inode", 2, 30)).alias("inode"), "pinode", F.concat("path", F.lit("x")).alias("path"), F.lit(0).alias("suspect"))
    return idx, tree.unionByName(made)


@query("SELECT * FROM (SELECT coalesce(i.inode, t.inode) AS inode, CASE WHEN t.path IS NULL THEN 'deleted' WHEN i.path IS NULL THEN 'created' WHEN i.pinode <> t.pinode OR i.path <> t.path THEN 'moved' WHEN suspect = 1 THEN 'suspect' END AS change FROM idx i FULL JOIN tree2 t ON i.inode = t.inode) WHERE change IS NOT NULL", _SNAP)
def incremental_diff(x: Index, s, d):
    return A.incremental_diff(*_snapshots(x)).select("inode", "change")


@query("SELECT t.inode, t.path FROM tree2 t WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.inode = t.inode)", _SNAP)
def created_anti(x: Index, s, d):
    idx, tree = _snapshots(x)
    return tree.join(idx.select("inode"), "inode", "left_anti").select("inode", "path")


@query("SELECT d.inode FROM dirs d LEFT JOIN entries e ON e.pinode = d.inode WHERE level = 4 GROUP BY d.inode HAVING coalesce(bool_or(greatest(ctime, mtime) >= 960000000), false)")
def suspects(x: Index, s, d):
    late = x.entries.groupBy("pinode").agg(F.bool_or(F.greatest("ctime", "mtime") >= 960000000).alias("late")).where("late")
    return x.dirs.where("level = 4").select("inode").join(late.select(C("pinode").alias("inode")), "inode", "left_semi")


_OUT = _TREE + ", tw AS (SELECT d.inode, d.pinode, d.path, d.level, t.totsize FROM tree t JOIN dirs d ON d.path = t.path)"


@query("SELECT path, totsize FROM (SELECT *, avg(totsize) OVER (PARTITION BY pinode) AS m, stddev_pop(totsize) OVER (PARTITION BY pinode) AS sd, count(*) OVER (PARTITION BY pinode) AS n FROM tw) WHERE n > 1 AND (totsize > m + 3 * sd OR totsize < m - 3 * sd)", _OUT)
def outliers_level(x: Index, s, d):
    return A.sibling_outliers(_sized(x), "totsize").where("outlier").select("path", "totsize")


def _sized(x: Index) -> DataFrame:
    tree = M.tree_summary(M.dir_summary(x.entries, x.dirs)).select("path", "totsize")
    return x.dirs.join(tree, "path").select("inode", "pinode", "path", "level", "totsize")


@query("SELECT level, count(*) AS n, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, round(avg({c}), 6) AS {c}_mean, CAST(median({c}) AS DOUBLE) AS {c}_median, round(stddev_pop({c}), 4) AS {c}_stdevp, count(DISTINCT {c}) AS {c}_unique" for c in ("totfiles", "totlinks", "totzero")) + " FROM summary GROUP BY level", _SUMMARY)
def snapshot_by_level(x: Index, s, d):
    out = A.snapshot(M.dir_summary(x.entries, x.dirs), ["level"], ["totfiles", "totlinks", "totzero"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("mean") else F.round(c, 4).alias(c) if c.endswith("stdevp") else C(c) for c in out.columns])


_DIRMODE = "dm AS (SELECT inode, pinode, level, CASE hash5 WHEN 0 THEN 509 WHEN 1 THEN 493 WHEN 2 THEN 488 ELSE 448 END AS mode, u AS uid, u % 3 AS gid FROM (SELECT inode, pinode, level, length(path) % 4 AS hash5, CASE WHEN level >= 3 THEN 7 ELSE level END AS u FROM dirs))"


def _modes(x: Index) -> DataFrame:
    h = F.length("path") % 4
    u = F.when(C("level") >= 3, 7).otherwise(C("level"))
    return x.dirs.select("inode", "pinode", "level", F.when(h == 0, 509).when(h == 1, 493).when(h == 2, 488).otherwise(448).alias("mode"), u.alias("uid"), (u % 3).alias("gid"))


@query("SELECT c.inode, ((p.mode & 5) = 5 AND (c.mode & 5) = 5 AND p.uid = c.uid AND p.gid = c.gid) OR ((p.mode & 365) = (c.mode & 365) AND p.uid = c.uid AND p.gid = c.gid) OR ((p.mode & 360) = (c.mode & 360) AND p.uid = c.uid AND p.gid = c.gid) OR ((p.mode & 320) = (c.mode & 320) AND p.uid = c.uid) AS legal FROM dm c JOIN dm p ON c.pinode = p.inode", _DIRMODE)
def rollup_pairs(x: Index, s, d):
    m = _modes(x)
    p = m.select(C("inode").alias("pinode"), *[C(c).alias(f"p{c}") for c in ("mode", "uid", "gid")])
    return m.select("inode", "pinode", *[C(c).alias(f"c{c}") for c in ("mode", "uid", "gid")]).join(p, "pinode").select("inode", M.rollup_legal("p", "c").alias("legal"))


@query("SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / sqrt(list_sum(list_transform(a.embedding, lambda v: CAST(v AS DOUBLE) * v)) * list_sum(list_transform(b.embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def vector_cosine(x: Index, s, d):
    e = table(s, d, "embeddings")
    one = e.where("vec_id = 0").select(C("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(S.cosine_distance(C("embedding"), C("q")), 6).alias("distance"))


@query("SELECT inode, sha256(name) AS name, sha256(pinode) AS parent FROM entries")
def trace_anonymise(x: Index, s, d):
    return x.entries.select("inode", F.sha2("name", 256).alias("name"), F.sha2("pinode", 256).alias("parent"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', '<EMAIL>', 'g'), '[0-9]{3}-[0-9]{2}-[0-9]{4}', '<SSN>', 'g') AS text FROM documents")
def anonymise_pii(x: Index, s, d):
    t = F.regexp_replace(F.regexp_replace("text", "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "<EMAIL>"), "[0-9]{3}-[0-9]{2}-[0-9]{4}", "<SSN>")
    return table(s, d, "documents").select("doc_id", t.alias("text"))


@query("SELECT event_type, make_timestamp(CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600000000) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def events_windows(x: Index, s, d):
    return streams.hourly_counts(table(s, d, "events"))


@query("SELECT inode, name, type, size, mtime FROM entries")
def trace_roundtrip(x: Index, s, d):
    return trace.parse(trace.format_lines(x.entries, x.dirs)).where("type <> 'd'").select("inode", "name", "type", "size", "mtime")


from . import more  # noqa: E402, F401  (registers its queries here)
