"""Registered queries against their SQL, and golden values of single functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treelake.functions import hist as H
from treelake.functions import scalar as S
from treelake.operators import analyses as A
from treelake.operators import find as P
from treelake.operators import summary as M
from treelake.plans import registry
from treelake.sources import trace
from treelake.sources.star import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in (r[i] for i in at)]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, spark, con):
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, got.fetchall()) == rows(df.columns, df.collect())


def test_rows_only(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, SF).count() >= 0
    assert entry.entry(spark).count() > 0


def test_every_entry_is_attached_and_listed(spark):
    x = load(spark, SF)
    assert registry.QUERIES["external_attach_all"](spark, SF).count() == x.entries.count()
    names = [r.name for r in x.entries.select("name").collect()]
    assert registry.QUERIES["ls_sorted_all"](spark, SF).count() == sum(not n.startswith(".") and not n.endswith("~") for n in names)


def test_deep_trees(spark):
    chain = [(i, i - 1, "/".join(map(str, range(i))), i, 5) for i in range(70)]
    tree = spark.createDataFrame([*chain, *[(100 + i, 69, f"leaf{i}", 70, 1000 if i == 7 else 5) for i in range(20)]], "inode long, pinode long, path string, level int, size long")
    assert [(r.path, r.outlier_type) for r in A.find_outliers(tree, "size").collect()] == [("leaf7", "no-subdirs")]
    # a chain deeper than 1000 levels, with an illegal pair at 600 to 601
    dirs = [(i, i - 1, i, 0o755, 1 if i <= 600 else 2, 1) for i in range(1100)]
    got = M.rollup_fixpoint(spark.createDataFrame(dirs, "inode long, pinode long, level int, mode int, uid long, gid long"))
    assert {r.inode: r.rolled for r in got.collect()} == {i: i > 600 for i in range(1100)}


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_scalar_goldens(spark):
    names = ["file.txt", "name.csv", "files.tar.gz", ".hidden", ".", "no-extension", None]
    assert one(spark, *[S.ext(F.lit(n).cast("string")) for n in names]) == ["txt", "csv", "gz", "hidden", None, None, None]
    assert one(spark, *[S.basename(F.lit(p).cast("string")) for p in (None, "", "///", "/a/b//", "c")]) == ["", "/", "/", "b", "c"]
    assert one(spark, *[S.modetotxt(F.lit(m)) for m in (0o100644, 0o40755, 0o104755, 0o101666)]) == ["-rw-r--r--", "drwxr-xr-x", "-rwsr-xr-x", "-rw-rw-rwT"]
    assert one(spark, *[S.blocksize(F.lit(1025), u) for u in ("K", "KB", "1024", "1K")]) == ["2K", "2KB", "2", "2"]
    with pytest.raises(ValueError):
        S.unit_factor("Q")


@pytest.mark.parametrize("base", [2, 10])
def test_log_hist_vector(spark, base):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 8, None)], "v long")
    text = H.log_text(H.buckets(df, [], H.log_bucket(F.col("v"), base, 3)), [], base, 3).first()[0]
    assert text == {2: "2;3;2;1;0:1;1:2;2:1;", 10: "10;3;2;0;0:5;"}[base]


def test_find_arguments(spark):
    df = spark.createDataFrame([("a.c", 1025, 0o644), ("B.c", 0, 0o600)], "name string, size long, mode long")
    keep = lambda c: [r.name for r in df.where(c).collect()]
    assert keep(P.size_is("2k")) == ["a.c"] and keep(P.iname_is("b*")) == ["B.c"] and keep(P.name_is("[!B]*")) == ["a.c"]
    assert keep(P.perm("/044")) == ["a.c"] and keep(P.perm("-600")) == ["a.c", "B.c"] and keep(P.perm("600")) == ["B.c"]


def test_trace_paths_may_hold_the_separator(spark):
    dirs = spark.createDataFrame([("d0", "", "")], "inode string, pinode string, path string")
    ent = spark.createDataFrame([("i", "d0", "odd\x1enämé", "f", 1, 2, 3, 4, 5, 6, 7)], "inode string, pinode string, name string, type string, mode long, uid long, gid long, size long, mtime long, ctime long, atime long")
    got = [r for r in trace.parse(trace.format_lines(ent, dirs)).collect() if r.type == "f"]
    assert (got[0].name, got[0].size, got[0].pinode) == ("odd\x1enämé", 4, "d0")


def test_owner_match_doesnt_gather_a_subtree(spark, monkeypatch):
    paths = ["", "a", "a/b", "a/b/c", "a/d", "ab", "ab/c", *[f"e{i}" for i in range(30)], *[f"e{i}/x" for i in range(30)]]
    dirs = spark.createDataFrame([(f"i{p}", p) for p in paths], "inode string, path string")
    below = lambda tops: sorted(p for p in paths if any(not t or p == t or p.startswith(f"{t}/") for t in tops))
    for tops in (["a", "a/b"], ["ab/c"], ["", "a"], [f"e{i}" for i in range(30)], []):
        owner = F.col("path").isin(tops)
        for most, crowd in ((100, 100), (0, 100), (0, 1)):
            monkeypatch.setattr(P, "MOST_OWNED", most)
            monkeypatch.setattr(P, "CROWD", crowd)
            got = P.owner_match(dirs, owner)
            assert sorted(r.path for r in got.collect()) == below(tops) and got.columns == dirs.columns
            if most:  # neither joined nor deduplicated by keys that a task would hold a subtree of
                assert "hashpartitioning(" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["files_per_level", "old_big_files", "find_perm_exact", "find_iname_regex", "find_samefile", "ls_long", "trace_full", "find_path_glob", "outliers_level", "du"])
def test_line_items_move_once(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert all("/testdata/" in f for f in df.inputFiles())  # nothing was written first
    plan = df._jdf.queryExecution().executedPlan().toString()
    by = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "l_orderkey" in line]
    # summaries stand in a plan several times, and their exchanges run once
    assert 0 < len(by) <= (4 if name == "outliers_level" else 2) and "hashpartitioning(o_custkey" not in plan
    if name in ("files_per_level", "ls_long", "trace_full", "find_path_glob"):
        assert not any("Exchange hashpartitioning(pinode" in line and "okey" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["ls_long", "find_path_glob", "find_printf_all", "stat_all"])
def test_owners_are_looked_up_by_order(spark, name):
    """No entry moves by its owner: below an exchange by uid there are directories and users only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning(uid#" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert not any("l_orderkey" in x for x in plan[i:below])
    assert any("Exchange hashpartitioning(o_custkey#" in line for line in plan) and any("l_orderkey" in line for line in plan)


@pytest.mark.parametrize("name", ["du", "outliers_level"])
def test_summaries_move_once(spark, name):
    """Directories meet their entries' sums once: children and ancestors of ``tree_summary`` read the same exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning(inode#" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1


def test_tree_summary_of_a_lone_root(spark):
    dirs = spark.createDataFrame([("root", "", 0, "")], "inode string, pinode string, level int, path string")
    ent = spark.createDataFrame([("root", "f", 700, 1, 2, 3, 4, 5)], "pinode string, type string, size long, uid long, gid long, mtime long, ctime long, atime long")
    got = M.tree_summary(M.dir_summary(ent, dirs)).collect()
    assert [(r.path, r.totsubdirs, r.totfiles, r.totsize, r.minuid, r.maxatime) for r in got] == [("", 0, 1, 700, 1, 5)]
