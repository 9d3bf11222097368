"""The query surface: temporary views over a tree, side tables, and tables made by commands."""

from __future__ import annotations

import csv
import io
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a template at most: they are repeated in every directory.
MOST_TEMPLATE = 1000


def view_frames(entries: DataFrame, dirs: DataFrame, xattrs: DataFrame) -> dict[str, DataFrame]:
    """The views by name.

    ``summary`` and ``vrsummary``: directories, the latter with dname, sname and the number of subdirectories;
    ``entries``, ``pentries`` (with the directory's parent) and ``vrpentries`` (with its columns, prefixed by d);
    x-views: joined with extended attributes, one row for each; e-views: restricted to a directory by their ``pinode``
    or ``inode``, which a flat table does for any of them.
    """
    kids = dirs.groupBy("pinode").agg(F.count(F.lit(1)).alias("srollsubdirs")).withColumnRenamed("pinode", "inode")
    vr = dirs.join(kids, "inode", "left").withColumns({"srollsubdirs": F.coalesce("srollsubdirs", F.lit(0).cast("long")), "dname": F.substring_index("path", "/", -1), "sname": F.col("path"), "sroll": F.lit(0)})
    up = dirs.select(F.col("inode").alias("pinode"), F.col("pinode").alias("ppinode"))
    own = [c for c in entries.columns if c not in ("ppinode", "path", "level")]
    pentries = entries.select(*own).join(up, "pinode")
    d = vr.select(*[F.col(c).alias("pinode" if c == "inode" else c if c in ("sname", "sroll", "srollsubdirs", "dname", "level", "path") else "ppinode" if c == "pinode" else f"d{c}") for c in vr.columns])
    vrp = entries.select(*[c for c in own if c not in ("dname",)]).join(d, "pinode")
    attrs = xattrs.select("inode", F.col("name").alias("xattr_name"), F.col("value").alias("xattr_value"))
    out = {"summary": dirs, "vrsummary": vr, "entries": entries, "pentries": pentries, "vrpentries": vrp}
    for n, base in (("xsummary", dirs), ("vrxsummary", vr), ("xentries", entries), ("xpentries", pentries), ("vrxpentries", vrp)):
        out[n] = base.join(attrs, "inode", "left")
    out |= {"summarylong": dirs, "vrsummarylong": vr, "xattrs": xattrs.distinct()}
    return out | {"e" + n: df for n, df in out.items() if n in ("summary", "pentries", "xsummary", "xpentries", "vrsummary", "vrpentries", "vrxsummary", "vrxpentries")}


def create_views(frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Temporary views for spark.sql; nothing is computed before a query asks."""
    for n, df in frames.items():
        df.createOrReplaceTempView(prefix + n)


def fixed_table(index, kind: str, *, min_level: int | None = None, max_level: int | None = None, start: str = "") -> DataFrame:
    """A table-valued form of summary, entries, pentries, vrsummary or vrpentries of an index, or of treesummary:
    all columns of the view and ``path, epath, fpath, rpath, level`` of the directory."""
    from ..operators import summary as M

    if kind == "treesummary":
        df = M.tree_summary(M.dir_summary(index.entries, index.dirs)).withColumn("level", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    else:
        df = view_frames(index.entries, index.dirs, index.xattrs)[kind]
        if "path" not in df.columns:
            df = df.drop("level").join(index.dirs.select(F.col("inode").alias("pinode"), "path", "level"), "pinode")
    rpath = F.concat_ws("/", F.nullif("path", F.lit("")), "name") if "entries" in kind else F.col("path")
    df = df.withColumns({"epath": F.substring_index("path", "/", -1), "fpath": F.concat_ws("/", F.lit(start.rstrip("/")), F.nullif("path", F.lit(""))), "rpath": rpath})
    if min_level is not None:
        df = df.where(F.col("level") >= min_level)
    return df if max_level is None else df.where(F.col("level") <= max_level)


def virtual_table(spark: SparkSession, name: str, index, **args) -> None:
    """A temporary view ``name`` of ``staged_query`` with key=value arguments."""
    from ..plans.staged import staged_query

    staged_query(spark, index, **args).createOrReplaceTempView(name)


def union_all(parts: dict[str, DataFrame], label: str = "host", then: str | None = None) -> DataFrame:
    """UNION ALL of results of several trees or machines, labelled; ``then``: SQL over them as ``parts``."""
    out = None
    for n, df in parts.items():
        one = df.withColumn(label, F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return _over(out.sparkSession, then, "parts", out) if then else out


def attach_external(index_dirs: DataFrame, external: DataFrame, basename: str, read, template: DataFrame) -> DataFrame:
    """A side table of every directory: rows of the registered databases of this base name, and the template's rows.

    ``external``: (type, pinode, filename ...); ``read`` takes a list of file names and gives a DataFrame with a column
    ``filename`` beside the table's.  The registry is filtered by type and base name, so only matching files are opened.
    UNION drops repeated rows, and a directory without a database has the template's rows alone, as every other.
    """
    wanted = external.where((F.col("type") == "user_db") & (F.substring_index("filename", "/", -1) == basename)).select("pinode", "filename").distinct()
    files = [r.filename for r in wanted.select("filename").distinct().toLocalIterator()]
    cols = template.columns
    # a template is the empty shape of a table, or a handful of default rows
    if template.limit(MOST_TEMPLATE + 1).count() > MOST_TEMPLATE:
        raise ValueError(f"a template of more than {MOST_TEMPLATE} rows")
    base = index_dirs.select(F.col("inode").alias("pinode")).join(F.broadcast(template), F.lit(True)) if template.head(1) else None
    rows = None
    if files:
        rows = read(files).join(wanted, "filename").select("pinode", *cols)
    if rows is None:
        return base if base is not None else index_dirs.select(F.col("inode").alias("pinode")).where("false").join(template, F.lit(False))
    return (rows if base is None else rows.union(base)).distinct()


def external_copy(spark: SparkSession, folder: str, pattern: str, sql: str, fmt: str = "parquet") -> DataFrame:
    """``sql`` over ``extdb``: all files under ``folder`` whose base name matches ``pattern``, with ``filename``.

    Spark holds no state between directories, so nothing leaks from one into the next.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.substring_index("path", "/", -1).rlike(pattern))
    files = [r.path for r in found.toLocalIterator()]
    if not files:
        raise ValueError(f"no file matches {pattern!r}")
    df = spark.read.format(fmt).load(files)
    return _over(spark, sql, "extdb", df.withColumn("filename", F.input_file_name()))


def _over(spark: SparkSession, sql: str, name: str, df: DataFrame) -> DataFrame:
    return spark.sql(re.sub(rf"\b{name}\b", "{" + name + "}", sql), **{name: df})


def run_vt(spark: SparkSession, command: list[str], columns: str, sep: str = "|", *, trusted: bool = False) -> DataFrame:
    """A table of a command's output, one row a line: ``columns`` is a DDL schema; missing fields are null.

    The command runs on the driver, and only where the caller says that it is ``trusted``.  Empty fields stay empty.
    """
    if not trusted:
        raise PermissionError("run_vt runs a command: pass trusted=True")
    out = subprocess.run(command, capture_output=True, text=True, check=True).stdout
    schema = spark.createDataFrame([], columns).schema
    rows = [(r + [None] * len(schema))[: len(schema)] for r in csv.reader(io.StringIO(out), delimiter=sep, quoting=csv.QUOTE_NONE)]
    text = spark.createDataFrame(rows, ", ".join(f"`{f.name}` string" for f in schema))
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def delimited(df: DataFrame, sep: str = "\x1e", suppress_newline: bool = False, newline: str = "\n") -> DataFrame:
    """(value): one line a row, nulls as empty text, as written to a terminal or file."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    end = "" if suppress_newline or newline == "\n" else newline
    return df.select(F.concat(F.concat_ws(sep, *cells), F.lit(end)).alias("value"))


def write_delimited(df: DataFrame, path: str, sep: str = "\x1e", single: bool = False) -> None:
    """Text files, one of each task, or a single one where the result is an aggregate."""
    out = delimited(df, sep)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_tables(df: DataFrame, path: str, single: bool = False) -> None:
    """Parquet files, one of each task, or a single one."""
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def parallel_find(entries: DataFrame, dirs: DataFrame, fmt: str = "%p\n", types: str = "dfl", where: Column | None = None) -> DataFrame:
    """(value): the format of ``find_printf`` over walked files and directories of some types."""
    from ..functions.formats import find_printf
    from ..plans.frontends import listing

    rows = listing(entries, dirs).where(F.col("type").isin(*types))
    return (rows if where is None else rows.where(where)).select(find_printf(fmt).alias("value"))
