"""The delimited text interchange of a tree: one line per directory, file, link or side database.

A line starts with its path, preceded by the path's length in bytes as four hex digits, so that a path may hold the
delimiter; link names, extended attributes and texts are preceded by their lengths as well.  A directory's line opens
a stanza, the lines of its files, links and side databases follow it.  Stanzas may come in any order: an entry says
which directory it belongs to by its parent's inode, so lines are parsed independently of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\x1e"
#: Between a name and a value, and after a value, of extended attributes.
XSEP = "\x1f"
#: The short form: ten fields, of which texts are not preceded by their length.
FIELDS = ["type", "inode", "mode", "uid", "gid", "size", "mtime", "ctime", "atime", "pinode"]
NUMBERS = ["mode", "nlink", "uid", "gid", "size", "blksize", "blocks", "atime", "mtime", "ctime"]
OSS = ["crtime", "ossint1", "ossint2", "ossint3", "ossint4"]


def _sized(x: Column, digits: int = 4) -> Column:
    """A text after its length in bytes."""
    x = F.coalesce(x, F.lit(""))
    return F.concat(F.lower(F.lpad(F.hex(F.octet_length(x)), digits, "0")), x)


def format_lines(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """(line) in the short form: a directory's own line and those of its entries; stanza order is left to the reader."""
    e = entries.join(dirs.select(F.col("inode").alias("pinode"), F.col("path").alias("dir")), "pinode")
    e = e.withColumn("path", F.concat_ws("/", F.nullif("dir", F.lit("")), "name"))
    d = dirs.select("path", F.lit("d").alias("type"), "inode", "pinode", *[F.lit(0).cast("long").alias(c) for c in ("mode", "uid", "gid", "size", "mtime", "ctime", "atime")])
    rows = e.select("path", *FIELDS).unionByName(d.select("path", *FIELDS))
    return rows.select(F.concat_ws(SEP, _sized(F.col("path")), *[F.col(c).cast("string") for c in FIELDS]).alias("line"))


def parse(lines: DataFrame, col: str = "line") -> DataFrame:
    """path, name and FIELDS of each line of the short form; lines whose prefix is no length have null fields."""
    raw = F.col(col).cast("binary")
    n = F.try_to_number(F.conv(F.substring(col, 1, 4), 16, 10), F.lit("99999")).cast("int")
    path = F.substring(raw, F.lit(5), n).cast("string")
    rest = F.split(F.expr(f"cast(substring(cast({col} as binary), 6 + cast(conv(substring({col}, 1, 4), 16, 10) as int)) as string)"), SEP)
    out = lines.select(path.alias("path"), *[F.get(rest, F.lit(i)).alias(c) for i, c in enumerate(FIELDS)])
    longs = [c for c in FIELDS if c not in ("type", "inode", "pinode")]
    return out.select("path", F.substring_index("path", "/", -1).alias("name"), *[F.expr(f"try_cast({c} as bigint)").alias(c) if c in longs else F.col(c) for c in FIELDS])


def full_lines(entries: DataFrame, dirs: DataFrame, external: DataFrame | None = None, sep: str = SEP, placed: bool = False) -> DataFrame:
    """(dpath, kind, line) of the full form, of tables as ``sources.store`` has them: sorted by these, each directory's
    line comes first and those of its entries and side databases follow.  ``placed``: entries have ``dpath`` of the
    directory that holds them already."""
    own = dirs.select("*", F.col("path").alias("dpath"), F.lit(0).alias("kind"))
    under = dirs.select(F.col("inode").alias("pinode"), F.col("path").alias("dpath"))
    e = entries if placed else entries.drop("dpath", "level", "start").join(under, "pinode")
    e = e.withColumn("path", F.concat_ws("/", F.nullif("dpath", F.lit("")), "name")).withColumn("kind", F.lit(1))
    rows = own.select("path", "dpath", "kind", "type", "inode", "pinode", "linkname", "xattrs", *NUMBERS, *OSS, "osstext1", "osstext2").unionByName(
        e.select("path", "dpath", "kind", "type", "inode", "pinode", "linkname", "xattrs", *NUMBERS, *OSS, "osstext1", "osstext2")
    )
    attrs = F.array_join(F.transform(F.coalesce("xattrs", F.array()), lambda x: F.concat(_sized(x["name"]), F.lit(XSEP), _sized(x["value"]), F.lit(XSEP))), "")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    parts = [_sized(F.col("path")), F.col("type"), F.col("inode"), *map(number, NUMBERS), _sized(F.col("linkname")), F.concat(F.lower(F.lpad(F.hex(F.octet_length(attrs)), 8, "0")), attrs)]
    parts += [*map(number, OSS), _sized(F.col("osstext1")), _sized(F.col("osstext2")), F.coalesce("pinode", F.lit(""))]
    out = rows.select("dpath", "kind", F.concat(F.concat_ws(sep, *parts), F.lit(sep)).alias("line"))
    if external is not None:
        x = external.join(under, "pinode").select("dpath", F.lit(1).alias("kind"), F.concat(_sized(F.col("filename")), F.lit(f"{sep}e{sep}")).alias("line"))
        out = out.unionByName(x)
    return out


def _cut(rest: Column, digits: int) -> tuple[Column, Column]:
    """(text, what follows its delimiter) of bytes that start with a length."""
    n = F.conv(F.substring(rest, 1, digits).cast("string"), 16, 10).try_cast("int")
    return F.substring(rest, F.lit(digits + 1), n), F.substring(rest, F.lit(digits + 2) + n, F.octet_length(rest))


def parse_full(lines: DataFrame, col: str = "line", sep: str = SEP) -> DataFrame:
    """path, name, every field and the parsed extended attributes of each line of the full form.

    Lines of side databases (type e) have null fields.  A line that breaks the grammar has type null, so that a reader
    can count it instead of failing.
    """
    raw = lines.select(F.col(col).cast("binary").alias("raw"))
    path, rest = _cut(F.col("raw"), 4)
    out = raw.select("raw", path.cast("string").alias("path"), rest.alias("rest"))
    # eleven fields without delimiters inside, then the rest as bytes
    head = F.split(F.col("rest").cast("string"), sep, 13)
    out = out.withColumn("head", head)
    fields = ["type", "inode", *NUMBERS]
    out = out.withColumns({c: F.get("head", F.lit(i)) for i, c in enumerate(fields)}).withColumn("rest", F.get("head", F.lit(len(fields))).cast("binary"))
    link, rest = _cut(F.col("rest"), 4)
    out = out.withColumns({"linkname": link.cast("string"), "rest": rest})
    attrs, rest = _cut(F.col("rest"), 8)
    out = out.withColumns({"attrs": attrs, "rest": rest})
    tail = F.split(F.col("rest").cast("string"), sep, 6)
    out = out.withColumn("tail", tail).withColumns({c: F.get("tail", F.lit(i)) for i, c in enumerate(OSS)}).withColumn("rest", F.get("tail", F.lit(5)).cast("binary"))
    one, rest = _cut(F.col("rest"), 4)
    out = out.withColumns({"osstext1": one.cast("string"), "rest": rest})
    two, rest = _cut(F.col("rest"), 4)
    out = out.withColumns({"osstext2": two.cast("string"), "pinode": F.rtrim(rest.cast("string"), F.lit(sep))})
    # names and values hold no XSEP; each has four digits before it
    pieces = F.filter(F.split(F.col("attrs").cast("string"), XSEP), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1), lambda i: F.struct(F.substring(F.get(pieces, 2 * i), 5, 1 << 30).alias("name"), F.substring(F.get(pieces, 2 * i + 1), 5, 1 << 30).alias("value")))
    out = out.withColumn("xattrs", F.when(F.size(pieces) >= 2, pairs).otherwise(F.array().cast("array<struct<name: string, value: string>>")))
    good = F.col("type").isin("d", "f", "l", "e")
    longs = {c: F.col(c).try_cast("bigint") for c in [*NUMBERS, *OSS]}
    return out.withColumns(longs).select(
        "path", F.substring_index("path", "/", -1).alias("name"), F.when(good, F.col("type")).alias("type"), "inode", *NUMBERS, "linkname", F.when(F.col("type").isin("d", "f", "l"), F.col("xattrs")).alias("xattrs"), *OSS, "osstext1", "osstext2", "pinode"
    )


def tables(parsed: DataFrame, start: str = "") -> tuple[DataFrame, DataFrame]:
    """(entries, dirs) of parsed lines, as ``sources.store.build_index`` takes them."""
    d = parsed.where("type = 'd'").withColumns({"level": F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))), "start": F.lit(start)})
    return parsed.where("type in ('f', 'l')").drop("path"), d


def verify(parsed: DataFrame) -> DataFrame:
    """(problem, path) of what is wrong with a trace: lines that break the grammar, entries whose directory has no line,
    directories without a parent's line, and paths that stand twice."""
    d = parsed.where("type = 'd'").select("inode").distinct()
    broken = parsed.where("type is null").select(F.lit("line").alias("problem"), "path")
    astray = parsed.where("type in ('f', 'l')").join(d.withColumnRenamed("inode", "pinode"), "pinode", "left_anti").select(F.lit("no directory").alias("problem"), "path")
    up = parsed.where("type = 'd' and path <> ''").join(d.withColumnRenamed("inode", "pinode"), "pinode", "left_anti").select(F.lit("no parent").alias("problem"), "path")
    twice = parsed.where("type in ('d', 'f', 'l')").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("twice").alias("problem"), "path")
    return broken.unionByName(astray).unionByName(up).unionByName(twice)


def verify_in_tree(parsed: DataFrame, dirs: DataFrame) -> DataFrame:
    """(side, path): directories that only the trace or only the index has."""
    t, i = parsed.where("type = 'd'").select("path"), dirs.select("path")
    return t.join(i, "path", "left_anti").select(F.lit("trace").alias("side"), "path").unionByName(i.join(t, "path", "left_anti").select(F.lit("index").alias("side"), "path"))


def anonymise(parsed: DataFrame, key: str = "") -> DataFrame:
    """Parsed lines whose names are hashed one path component at a time, so that the tree keeps its shape; link names
    and texts are hashed too, extensions stay, owners become numbers of a hash, and attributes lose their values."""
    hide = lambda x: F.when(x == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(key), x), 256), 1, 16))
    path = lambda c: F.array_join(F.transform(F.split(c, "/"), hide), "/")
    dot = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    number = lambda c: F.pmod(F.xxhash64(F.lit(key), c), F.lit(1 << 31))
    attrs = F.transform("xattrs", lambda x: F.struct(hide(x["name"]).alias("name"), F.lit("").alias("value")))
    changed = {"path": F.concat(path("path"), F.when(F.col("type") == "d", "").otherwise(dot)), "name": F.concat(hide(F.col("name")), F.when(F.col("type") == "d", "").otherwise(dot)), "linkname": path("linkname"), "osstext1": hide(F.col("osstext1")), "osstext2": hide(F.col("osstext2")), "uid": number("uid"), "gid": number("gid"), "xattrs": attrs}
    return parsed.withColumns(changed)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path).withColumnRenamed("value", "line"))


def write_trace(entries: DataFrame, dirs: DataFrame, path: str) -> None:
    format_lines(entries, dirs).write.mode("overwrite").text(path)


def read_full(spark: SparkSession, path: str, sep: str = SEP, stream: bool = False) -> DataFrame:
    """Parsed lines of trace files; ``stream`` reads files as they arrive in the folder."""
    reader = spark.readStream if stream else spark.read
    return parse_full(reader.text(path).withColumnRenamed("value", "line"), sep=sep)


def write_full(entries: DataFrame, dirs: DataFrame, path: str, external: DataFrame | None = None, sep: str = SEP) -> None:
    """Trace files in which stanzas are whole: a directory's lines lie together, its own first."""
    lines = full_lines(entries, dirs, external, sep)
    lines.repartition("dpath").sortWithinPartitions("dpath", "kind", "line").select("line").write.mode("overwrite").text(path)
