"""Walking, storing, traces and side databases on a small tree on disk."""

import os

import pytest
from pyspark.sql import functions as F

from treelake.sources import posix, store, trace


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """The shape of a standard test tree: hidden and odd names, links, empty and leaf directories."""
    root = tmp_path_factory.mktemp("tree")
    files = {"1KB": 1024, "1MB": 1 << 20, "directory/executable": 1, "directory/readonly": 2, "directory/writable": 3, "directory/subdirectory/repeat_name": 5, ".hidden": 10, "leaf_directory/leaf_file1": 11, "leaf_directory/leaf_file2": 12, "old_file": 0, "repeat_name": 14, "unusual#? directory ,/unusual, name?#": 15}
    (root / "empty_directory").mkdir()
    for name, size in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
        p.chmod(0o644)
        os.utime(p, (size, size))
    (root / "file_symlink").symlink_to("1KB")
    (root / "directory/subdirectory/directory_symlink").symlink_to("../subdirectory")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    return posix.index_tree(spark, [tree], str(tmp_path_factory.mktemp("index")))


def test_walk(index):
    e = {(f"{r.dpath}/" if r.dpath else "") + r.name: r for r in index.entries.collect()}
    assert len(e) == 14 and sum(r.type == "f" for r in e.values()) == 12 and sum(r.size for r in e.values() if r.type == "f") == 1049673
    assert {r.path: r.level for r in index.dirs.collect()} == {"": 0, "directory": 1, "directory/subdirectory": 2, "empty_directory": 1, "leaf_directory": 1, "unusual#? directory ,": 1}
    assert e["file_symlink"].linkname == "1KB" and e["unusual#? directory ,/unusual, name?#"].mtime == 15 and e["1MB"].level == 0


def test_walk_options(spark, tree):
    _, dirs = posix.walk(spark, [tree], max_level=1, skip=["leaf_directory"])
    assert {r.path for r in dirs.collect()} == {"", "directory", "empty_directory", "unusual#? directory ,"}
    entries, dirs = posix.walk(spark, [tree], path_list=["directory"], enter=F.col("name") != "subdirectory")
    assert {r.path for r in dirs.collect()} == {"directory"} and entries.count() == 3


def test_full_trace_round_trip(spark, index, tmp_path):
    x = [("user.a", "1"), ("user.b", "é=2")]
    odd = index.entries.withColumn("xattrs", F.when(F.col("name") == "1KB", F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in x])).otherwise(F.col("xattrs")))
    odd = odd.withColumn("name", F.when(F.col("name") == ".hidden", "odd\x1enämé").otherwise(F.col("name"))).withColumn("osstext1", F.lit("te\x1ext")).withColumn("ossint3", F.lit(7).cast("long"))
    side = spark.createDataFrame([("user_db", index.dirs.where("level = 0").first().inode, "/some/where.db", None, None, None)], store.EXTERNAL_COLUMNS)
    path = f"{tmp_path}/trace"
    trace.write_full(odd, index.dirs, path, side)
    got = trace.read_full(spark, path)
    entries, dirs = trace.tables(got)
    cols = [c for c in store.ENTRIES if c != "atime"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(entries) == key(odd) and key(dirs.where("path <> ''")) == key(index.dirs.where("path <> ''"))
    assert [r.path for r in got.where("type = 'e'").collect()] == ["/some/where.db"]
    assert trace.verify(got).count() == 0 and trace.verify_in_tree(got, index.dirs).count() == 0
    # every stanza begins with its directory
    first = [line for f in os.listdir(path) if f.startswith("part") for line in open(f"{path}/{f}").read().split("\n")[:1] if line]
    assert first and all(f"{trace.SEP}d{trace.SEP}" in line for line in first)


def test_trace_as_a_stream(spark, index, tmp_path):
    trace.write_full(index.entries, index.dirs, f"{tmp_path}/in")
    rows = trace.read_full(spark, f"{tmp_path}/in", stream=True)
    q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_verify_finds_what_is_wrong(spark, index):
    lines = trace.full_lines(index.entries, index.dirs).select("line")
    bad = lines.where(~F.col("line").contains("leaf_directory" + trace.SEP)).unionByName(spark.createDataFrame([("zzzz broken",)], "line string")).unionByName(lines.where(F.col("line").contains("1MB")))
    got = sorted((r.problem, r.path) for r in trace.verify(trace.parse_full(bad)).collect())
    assert [p for p, _ in got] == ["line", "no directory", "no directory", "twice"] and got[1][1] == "leaf_directory/leaf_file1"


def test_anonymised_trace_keeps_its_shape(index):
    parsed = trace.parse_full(trace.full_lines(index.entries, index.dirs))
    hidden = trace.anonymise(parsed, "k")
    assert trace.verify(hidden).count() == 0
    paths = [r.path for r in hidden.collect()]
    assert len(set(paths)) == 20 and not any(w in p for p in paths for w in ("leaf", "1KB", "unusual")) and sum(p.endswith(".hidden") for p in paths) == 1


def test_rewrites_and_top_info(spark, index, tmp_path):
    s = store.build_index(index.entries, index.dirs, str(tmp_path / "i"), name="one")
    store.update(s, "entries", F.col("name") == "1KB", uid=F.lit(77).cast("long"))
    store.delete(s, "entries", F.col("type") == "l")
    assert s.entries.count() == 12 and s.entries.where("uid = 77").first().name == "1KB"
    store.insert(s, "entries", s.entries.where("name = '1MB'"))
    assert s.entries.where("name = '1MB'").count() == 2
    store.top_insert(spark, s.path, "two", 1, 3)
    store.top_set(spark, s.path, "two", notes="second")
    assert {(r.name, r.notes) for r in s.top_info.collect()} == {("one", ""), ("two", "second")} and s.top_info.where("name = 'two'").first().duration == 2
    store.top_delete(spark, s.path, "one")
    assert [r.name for r in s.top_info.collect()] == ["two"]


def test_external_list(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "side.db").write_bytes(b"1")
    (tmp_path / "a" / posix.EXTERNAL_LIST).write_text("side.db\nmissing.db\n")
    _, dirs = posix.walk(spark, [str(tmp_path)])
    assert {os.path.basename(r.filename) for r in posix.external_databases(spark, dirs).collect()} == {"side.db", "missing.db"}
    assert [os.path.basename(r.filename) for r in posix.external_databases(spark, dirs, check=True).collect()] == ["side.db"]
