"""Front ends on the shape of a standard test tree, names for spark.sql, staged queries, plugins and histograms in text."""

import statistics
import sys

import pytest
from pyspark.sql import functions as F

from treelake.functions import formats
from treelake.functions import hist as H
from treelake.functions import scalar as S
from treelake.functions.register import register
from treelake.operators import analyses as A
from treelake.operators import find as P
from treelake.operators import summary as M
from treelake.plans import frontends, plugins, staged
from treelake.sources import views

DIRS = {"": 17, "directory": 7, "directory/subdirectory": 6, "empty_directory": 8, "leaf_directory": 13, "unusual#? directory ,": 16}
FILES = {
    "1KB": (1024, 0o664), "1MB": (1048576, 0o664), "directory/executable": (1, 0o777), "directory/readonly": (2, 0o444), "directory/writable": (3, 0o666), "directory/subdirectory/repeat_name": (5, 0o664), ".hidden": (10, 0o664),
    "leaf_directory/leaf_file1": (11, 0o664), "leaf_directory/leaf_file2": (12, 0o664), "old_file": (0, 0o664), "repeat_name": (14, 0o664), "unusual#? directory ,/unusual, name?#": (15, 0o664),
}
LINKS = {"directory/subdirectory/directory_symlink": ("subdirectory", 4), "file_symlink": ("1KB", 9)}
ATTRS = {"1MB": ["user.size"], "leaf_directory/leaf_file1": ["user.name1", "user.name2", "user.name3"], "leaf_directory/leaf_file2": ["user.name4", "user.name5", "user.name6"]}


class Tree:
    """The standard tree in memory; inodes are paths."""

    def __init__(self, spark):
        up = lambda p: p.rpartition("/")[0]
        rows = [(p.rpartition("/")[2], "f", "i:" + p, "i:" + up(p), m, s, s, "", [(a, "v") for a in ATTRS.get(p, [])]) for p, (s, m) in FILES.items()]
        rows += [(p.rpartition("/")[2], "l", "i:" + p, "i:" + up(p), 0o120777, 8, t, to, []) for p, (to, t) in LINKS.items()]
        schema = "name string, type string, inode string, pinode string, mode long, size long, mtime long, linkname string, xattrs array<struct<name: string, value: string>>"
        more = {"nlink": 1, "uid": 1001, "gid": 1002, "blksize": 4096, "crtime": 0, "ossint1": 0, "ossint2": 0, "ossint3": 0, "ossint4": 0}
        e = spark.createDataFrame(rows, schema).withColumns({c: F.lit(v).cast("long") for c, v in more.items()} | {"blocks": S.quotient_up(F.col("size"), 512), "atime": F.col("mtime"), "ctime": F.col("mtime"), "osstext1": F.lit(""), "osstext2": F.lit("")})
        self.entries = e.withColumn("mode", F.when(F.col("type") == "f", F.col("mode") + 0o100000).otherwise(F.col("mode")))
        d = [("i:" + p, "" if p == "" else "i:" + up(p), p, 0 if p == "" else p.count("/") + 1, t) for p, t in DIRS.items()]
        self.dirs = spark.createDataFrame(d, "inode string, pinode string, path string, level int, mtime long").withColumns({c: F.lit(v).cast("long") for c, v in (("mode", 0o40775), ("nlink", 2), ("uid", 1001), ("gid", 1002), ("size", 4096), ("blksize", 4096), ("blocks", 8), ("crtime", 0))} | {"atime": F.col("mtime"), "ctime": F.col("mtime")})
        self.xattrs = self.entries.select("inode", F.explode("xattrs").alias("x")).select("inode", "x.name", "x.value")
        self.rows = frontends.listing(self.entries, self.dirs, spark.createDataFrame([(1001, "ann")], "uid long, user string"), None, start="prefix")


@pytest.fixture(scope="module")
def tree(spark):
    return Tree(spark)


def values(df, col=0):
    return [r[col] for r in df.collect()]


def test_summaries_have_the_known_figures(tree):
    full = M.full_tree_summary(M.full_summary(tree.entries, tree.dirs))
    r = {x.path: x for x in full.collect()}
    root, one = r[""], r["directory"]
    assert (root.totfiles, root.totlinks, root.totsize, root.totzero, root.totltk, root.totmtk, root.totltm, root.totmtm, root.totmtg, root.totmtt, root.totxattr) == (12, 2, 1049673, 1, 11, 1, 12, 0, 0, 0, 7)
    assert (one.totfiles, one.totlinks, one.totsize, one.totltk, one.totltm, one.totxattr) == (4, 1, 11, 4, 4, 0)
    assert values(M.one_tree_summary(M.dir_summary(tree.entries, tree.dirs), "directory").select("totsize")) == [11]


def test_find(tree):
    find = lambda **k: sorted(values(frontends.find(tree.rows, **k)))
    assert find(size="+1k", type="f") == ["1MB"] and find(name=["leaf*1", "*KB"]) == ["1KB", "leaf_directory/leaf_file1"]
    assert find(empty=True) == ["empty_directory", "old_file"] and find(perm="777", type="f") == ["directory/executable"]
    assert find(iname="REPEAT*", maxdepth=1) == ["repeat_name"] and find(mindepth=3) == ["directory/subdirectory/directory_symlink", "directory/subdirectory/repeat_name"]
    assert find(user="ann", lname="file*") == ["file_symlink"] and find(path="*/sub*", type="d") == ["directory/subdirectory"]
    assert find(samefile="i:1KB") == ["1KB"] == find(inum="i:1KB") and find(group="1002", newer=1_000_000, type="f") == ["1MB"] and find(false=True) == []
    assert values(frontends.find(tree.rows, type="f", largest=True, num_results=2)) == ["1MB", "1KB"] and values(frontends.find(tree.rows, type="f", smallest=True, num_results=1)) == ["old_file"]
    assert frontends.find(tree.rows, name="1KB", ls=True).first().permissions == "-rw-rw-r--"
    with pytest.raises(ValueError):
        find(xtype="f")


def test_find_printf(tree):
    show = lambda fmt, **k: values(frontends.find(tree.rows, printf=fmt, **k))
    assert show(r"%p %s\n", name="1KB") == ["1KB 1024\n"] and show("%5s|%-6s|%06s|%f", name="1KB") == [" 1024|1024  |001024|1KB"]
    assert show(r"%u:%g %m %M %y %d %n %b %k %H", name="1KB") == ["ann:1002 664 -rw-rw-r-- f 1 1 16 8 prefix"]
    assert show(r"%l\t%%\101\q%", name="file_symlink") == ["1KB\t%A\\q"] and show(r"a\cb", name="1KB") == ["a"] and show("%Q%3Q", name="1KB") == ["%Q%3Q"]
    assert show("%S", name="old_file") == ["0"] and show("%.2f|%5.2f|%h", name="1KB") == ["1K|   1K|1KB"]


def test_stat(tree):
    one = lambda **k: frontends.stat(tree.rows.where("path = 'file_symlink'"), **k).first().value
    assert one(fmt="%N %F %a %A %f %U %G %h %w %W") == "'file_symlink' -> '1KB' symbolic link 777 lrwxrwxrwx a1ff ann UNKNOWN 1 - 0"
    assert one(fmt="%x|%Y|%z|%5a|%-5s|%%|%q") == "1970-01-01 00:00:09 +0000|9|1970-01-01 00:00:09 +0000|  777|8    |%|?" and one(printf=r"%n\x41\102\e\"\?") == 'file_symlinkAB\x1b"?'
    assert one().startswith("  File: 'file_symlink' -> '1KB'\n  Size: 8         \tBlocks: 1          IO Block: 4096   symbolic link\n") and one(terse=True).startswith("file_symlink 8 1 a1ff 1001 1002 ?")


def test_ls(tree):
    names = lambda **k: values(frontends.ls(tree.rows, **k).select("name"))
    assert names() == ["1KB", "1MB", "directory", "empty_directory", "file_symlink", "leaf_directory", "old_file", "repeat_name", "unusual#? directory ,"]
    assert names(all=True)[0] == ".hidden" and names(sort="size")[0] == "1MB" and names(reverse=True)[-1] == "1KB" and names(directory="leaf_directory", sort="mtime") == ["leaf_file2", "leaf_file1"]
    row = frontends.ls(tree.rows, long=True, human_readable=True, now=100, time_style="long-iso").where("name = '1KB'").first()
    assert (row.size, row.time, row.owner) == ("1.0K", "1970-01-01 00:17:04", "ann")
    assert frontends.ls(tree.rows, long=True, now=20_000_000).where("name = '1KB'").first().time == "Jan   1  1970"
    with pytest.raises(ValueError):
        names(long=True, time_style="odd")


def test_du_and_getfattr(tree):
    used = lambda **k: {r.path: r.used for r in frontends.du(tree.entries, tree.dirs, **k).collect()}
    assert used(apparent_size=True)[""] == "1049673" and used(directory="directory", summarize=True, apparent_size=True) == {"directory": "11"}
    assert used(directory="directory", inodes=True, total=True) == {"directory": "7", "directory/subdirectory": "3", "total": "7"} and used(directory="directory", separate_dirs=True, apparent_size=True) == {"directory": "6", "directory/subdirectory": "5"}
    assert used(summarize=True, apparent_size=True, human_readable=True) == {"": "1.0M"} and used(summarize=True, apparent_size=True, block_size="K") == {"": "1026K"} and set(used(max_depth=0)) == {""}
    attrs = frontends.getfattr(tree.rows, tree.xattrs, recursive=True, directory="leaf_directory")
    assert sorted((r.path[-1], r.name) for r in attrs.collect())[0] == ("1", "user.name1") and attrs.count() == 6
    assert values(frontends.getfattr(tree.rows, tree.xattrs, directory="1MB", name="user.size")) == ["1MB"]


def test_names_in_sql(spark):
    names = register(spark, clock=1000, users={1: "ann"}, run_commands=True)
    assert len(names) > 35
    got = spark.sql("SELECT intcat(0), intcat(999999), bytecat(1024), age_of(940), age_in(0, 'm'), human_readable_size(1536), modetotxt(3565), basename('/a/b//'), ext('x.tar.gz'), ext('a.'), pad_right('abc', 2), rpath('', 0, 'n'), uidtouser(1), uidtouser(5), blocksize(1025, 'KB'), c_strftime('%Y', 0), strop('echo hi; echo no'), intop('echo -42')").first()
    assert list(got) == ["Zero", "K", "K", "Mins", 16, "1.5K", got[6], "b", "gz", None, "abc", "n", "ann", "5", "2KB", "1970", "hi", -42]
    assert got[6] == spark.range(1).select(S.modetotxt(F.lit(3565))).first()[0]
    with pytest.raises(Exception, match="not a number"):
        spark.sql("SELECT age_of(1001)").collect()
    row = spark.sql("SELECT stdevs(x), stdevp(x), median_of(x), log_hist(x, 2, 3), mode_count(cast(x AS string)), category_hist(cast(x AS string), 0) FROM VALUES (0L), (1L), (2L), (3L), (4L), (8L), (8L) t(x)").first()
    v = [0, 1, 2, 3, 4, 8, 8]
    assert row[0] == pytest.approx(statistics.stdev(v)) and row[1] == pytest.approx(statistics.pstdev(v)) and list(row[2:]) == [3.0, "2;3;1;2;0:1;1:2;2:1;", "1:8:2;", "1;1:8:2;"]
    merged = spark.sql("SELECT log_hist_combine(h) FROM VALUES ('2;3;2;1;0:1;1:2;2:1;'), ('0;0;0;0;'), ('2;3;1;0;1:1;') t(h)").first()[0]
    assert merged == "2;3;3;1;0:1;1:3;2:1;"
    assert spark.sql("SELECT median_of(x), stdevs(x) FROM VALUES (1L) t(x)").first()[:] == (1.0, None)


def test_histograms_in_text():
    assert H.write_log(*H.count_log(["", "a", "ab", "abc", "abcd", "x" * 8, None], 2, 3)) == "2;3;2;1;0:1;1:2;2:1;"
    assert H.write_log(*H.count_log([5_000_000_000, -1, 0.5], 2, 60)) == "2;60;1;0;32:1;" and H.combine_log([]) == "0;0;0;0;"
    for bad in (lambda: H.combine_log(["2;3;0;0;", "10;3;1;0;"]), lambda: H.combine_times(["5;0:1;", "6;0:1;"]), lambda: H.count_log([1], 1, 3)):
        with pytest.raises(ValueError):
            bad()
    assert H.combine_times(["0;", "5;0:2;60:6;", "5;0:1;"]) == "5;0:3;60:6;" and H.combine_modes(["644:2;", "600:1;644:1;"]) == "600:1;644:3;"
    odd = {"a:b;": 2, "": 1, "3:x": 4}
    assert H.read_categories(H.write_categories(odd)) == odd and H.combine_categories([H.write_categories(odd)] * 2) == H.write_categories({k: 2 * n for k, n in odd.items()})
    assert [H.extension(n) for n in ("a.txt", ".hidden", "x.", "none")] == ["txt", "hidden", "no-ext", "no-ext"]


def test_extension_histograms_of_the_tree(tree):
    h = H.category_text(H.buckets(tree.entries, [], F.coalesce(S.ext(F.col("name")), F.lit("no-ext"))), [])
    assert values(h) == [H.write_categories({"no-ext": 13, "hidden": 1})] == ["2;6:hidden:1;" + "6:no-ext:13;"]
    assert values(H.category_text(H.buckets(tree.entries, [], F.coalesce(S.ext(F.col("name")), F.lit("no-ext"))), [], keep1=False)) == ["1;6:no-ext:13;"]


def test_scalars_at_their_limits(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.blocksize(F.lit(2**53 + 1), "1")) == str(2**53 + 1) and one(S.quotient_up(F.lit(2**62 + 1), 2)) == 2**61 + 1
    for ahead in (S.agecat(F.lit(11), 10), S.epochtoage(F.lit(11), 10)):
        with pytest.raises(Exception, match="ahead of the clock"):
            one(ahead)
    assert one(F.lit("a.c\n").rlike(S.glob_to_regex("*.c"))) is False and one(S.strftime("%e %R %C %u %j %%", F.lit(0))) == " 1 00:00 19 4 001 %"
    with pytest.raises(ValueError):
        S.strftime("%Q", F.lit(0))
    assert one(S.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0
    assert [one(formats.padded(F.lit(x), w, n)) for x, w, n in (("-5", "05", True), ("7", "+3", True), ("abc", "-5", False), ("abcdef", ".2", False), ("12", ".4", True))] == ["-0005", " +7", "abc  ", "ab", "0012"]


def test_medians(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randint(-5, 5), r.randint(-(2**61), 2**61), None])) for _ in range(400)]
    got = {x.g: x["median"] for x in A.medians(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    assert got == {g: pytest.approx(statistics.median(v for k, v in rows if k == g and v is not None)) for g in ("a", "b", None)}
    assert A.medians(spark.createDataFrame([("a", None)], "g string, v long"), ["g"], "v").count() == 0


def test_staged_query(spark, tree):
    run = lambda **k: staged.staged_query(spark, tree, **k)
    assert sorted(values(run(entries="SELECT name FROM pentries WHERE size > 1000"))) == ["1KB", "1MB"]
    # a query runs only where the one before gave a row, unless every query is to run everywhere
    gate = {"summary": "SELECT inode FROM vrsummary WHERE dname = 'leaf_directory'", "entries": "SELECT name FROM entries"}
    assert sorted(values(run(**gate))) == ["leaf_file1", "leaf_file2"] and run(**gate, process=2).count() == 14
    assert sorted(values(run(summary="SELECT {n} AS v, {i} AS p, {} AS e FROM vrsummary WHERE level = {lv}".replace("{} AS e", "1 AS e"), strings={"lv": "2"}))) == ["subdirectory"]
    assert values(run(entries="SELECT size FROM entries", then="SELECT sum(size) AS s FROM intermediate", final="SELECT s + 1 FROM aggregate", max_level=0)) == [1049624 + 8 + 1]
    assert run(entries="SELECT name FROM entries", paths=["directory"], skip=["subdirectory"]).count() == 3
    for bad in ({"summary": "SELECT {no} FROM summary"}, {"summary": "SELECT 1 AS x FROM summary", "entries": "SELECT name FROM entries"}, {}):
        with pytest.raises(ValueError):
            run(**bad).collect()
    t = staged.template(spark, tree, "files", filters={"name": ("like", "leaf%")}, order_by="-size", limit=1)
    assert values(t.select("name")) == ["leaf_file2"]
    with pytest.raises(ValueError):
        staged.template(spark, tree, "files", filters={"name; drop": "x"})


def test_views_and_tables(spark, tree, tmp_path):
    frames = views.view_frames(tree.entries, tree.dirs, tree.xattrs)
    assert {"vrpentries", "xpentries", "evrxsummary", "esummary"} <= set(frames) and frames["vrxpentries"].count() == 18
    views.create_views(frames, "t_")
    assert spark.sql("SELECT sum(srollsubdirs) FROM t_vrsummary").first()[0] == 5
    assert set(values(views.fixed_table(tree, "pentries", max_level=0).select("rpath"))) == {n for n in [*FILES, *LINKS] if "/" not in n}
    assert views.fixed_table(tree, "treesummary", min_level=2).first().path == "directory/subdirectory"
    views.virtual_table(spark, "vt_names", tree, entries="SELECT name FROM entries")
    assert spark.table("vt_names").count() == 14
    with pytest.raises(PermissionError):
        views.run_vt(spark, ["echo"], "a int")
    got = views.run_vt(spark, [sys.executable, "-c", "print('1||x'); print('z|2'); print('3')"], "a int, b int, c string", trusted=True)
    assert [tuple(r) for r in got.collect()] == [(1, None, "x"), (None, 2, None), (3, None, None)]
    assert values(views.delimited(spark.createDataFrame([(1, None, "a")], "a int, b int, c string"), "|")) == ["1||a"]
    views.write_delimited(tree.entries.select("name", "size").where("size > 1000"), f"{tmp_path}/out", "|", single=True)
    assert sorted(values(spark.read.text(f"{tmp_path}/out"))) == ["1KB|1024", "1MB|1048576"]
    for k in (1, 2):
        views.write_tables(spark.createDataFrame([(k,)], "k int"), f"{tmp_path}/dbs/side{k}.db", single=True)
    both = views.union_all({"a": tree.dirs.select("path"), "b": tree.dirs.select("path")}, then="SELECT host, count(*) AS n FROM parts GROUP BY host")
    assert {(r.host, r.n) for r in both.collect()} == {("a", 6), ("b", 6)}
    assert sorted(values(views.external_copy(spark, f"{tmp_path}/dbs", r"^part-.*\.parquet$", "SELECT k * 10 AS k FROM extdb"))) == [10, 20]
    with pytest.raises(ValueError):
        views.external_copy(spark, f"{tmp_path}/dbs", "none", "SELECT * FROM extdb")


def test_long_path_lists(tree):
    many = ["directory", "leaf_directory", *(f"none{i}" for i in range(30))]
    short, long = P.path_list(tree.dirs, many[:2]), P.path_list(tree.dirs, many)
    assert sorted(values(short.select("path"))) == sorted(values(long.select("path"))) == ["directory", "directory/subdirectory", "leaf_directory"]


def test_plugins(spark, tree):
    class Small(plugins.Plugin):
        def file_action(self):
            return F.when(F.col("size") > 1000, plugins.SKIP).otherwise(plugins.PROCESS)

        def dir_action(self):
            return F.when(F.col("path") == "empty_directory", plugins.SKIP).otherwise(plugins.PROCESS)

    entries, dirs = plugins.apply_plugins(spark, tree.entries, tree.dirs, [plugins.SnapshotDirs(("directory",)), Small()])
    assert set(values(dirs.select("path"))) == {"", "leaf_directory", "unusual#? directory ,"} and entries.count() == 7
    attrs = tree.entries.withColumn("xattrs", F.array(F.struct(F.lit("user.stripe_count").alias("name"), F.lit("4").alias("value"))))
    assert set(values(plugins.Stripes().transform_entries(attrs).select("ossint1"))) == {4}
    plugins.Pii().register(spark)
    text = "mail a.b@ex-ample.org or 555-12-3456, 10.0.0.255, 4111 1111 1111 1111"
    hidden, found = spark.sql("SELECT pii_hide(:t), pii_found(:t)", args={"t": text}).first()
    assert hidden == "mail <EMAIL_ADDRESS> or <US_SSN>, <IP_ADDRESS>, <CREDIT_CARD>" and {(f.label, f.n) for f in found} >= {("EMAIL_ADDRESS", 1), ("US_SSN", 1)}
    plugins.Collections().register(spark)
    name, uuid = spark.sql("SELECT collection_name('a/b/c/d'), collection_uuid('a/b/c/d')").first()
    assert name == "a/b" and len(uuid) == 36
