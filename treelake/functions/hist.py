"""Mergeable histograms: a table of (group, bucket, count) inside, the serialised text at the edge.

Counting is one hash aggregation on (group, bucket), so a hot group is pre-aggregated map side; only the buckets of a
group, a bounded number for all but category histograms, meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGES = [0, 1, 60, 3600, 86400, 604800, 2419200, 31536000, 63072000, 157680000, 315360000, 630720000]


def text_of(items: Column) -> Column:
    """Serialised, sorted items: an array of structs (key..., txt)."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["txt"]), "")


def buckets(df: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine bucket tables of any number of parts."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def log_bucket(x: Column, base: int, count: int) -> Column:
    """floor(log_base x) by integer thresholds; -1 below 1, ``count`` from base**count on.  Null counts as 0."""
    x = F.coalesce(x, F.lit(0))
    out = F.lit(count)
    for k in range(count - 1, -1, -1):
        if base ** (k + 1) < 1 << 63:
            out = F.when(x < F.lit(base ** (k + 1)).cast("long"), F.lit(k)).otherwise(out)
        else:
            out = F.lit(k)
    return F.when(x < 1, F.lit(-1)).otherwise(out)


def log_text(parts: DataFrame, by: list[str], base: int, count: int) -> DataFrame:
    at = lambda k: F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("n"))), F.lit(0)).cast("string")
    inner = F.collect_list(F.when((F.col("bucket") >= 0) & (F.col("bucket") < count), F.struct("bucket", F.concat("bucket", F.lit(":"), "n", F.lit(";")).alias("txt"))))
    return parts.groupBy(*by).agg(F.concat(F.lit(f"{base};{count};"), at(-1), F.lit(";"), at(count), F.lit(";"), text_of(inner)).alias("hist"))


def mode_text(parts: DataFrame, by: list[str]) -> DataFrame:
    item = F.concat(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 8), 3, "0"), F.lit(":"), "n", F.lit(";"))
    return parts.groupBy(*by).agg(text_of(F.collect_list(F.struct("bucket", item.alias("txt")))).alias("hist"))


def time_bucket(t: Column, ref: int) -> Column:
    dt = F.lit(ref) - F.coalesce(t, F.lit(0))
    out = F.lit(630720001)
    for a in reversed(AGES):
        out = F.when(dt < a, F.lit(a)).otherwise(out)
    return out


def time_text(parts: DataFrame, by: list[str], ref: int) -> DataFrame:
    item = F.concat("bucket", F.lit(":"), "n", F.lit(";"))
    return parts.groupBy(*by).agg(F.concat(F.lit(f"{ref};"), text_of(F.collect_list(F.struct("bucket", item.alias("txt"))))).alias("hist"))


def category_text(parts: DataFrame, by: list[str], keep1: bool = True) -> DataFrame:
    """Sorted by name; null names are skipped; without ``keep1`` names seen once are."""
    use = F.col("bucket").isNotNull() & (F.lit(keep1) | (F.col("n") > 1))
    item = F.concat(F.length("bucket"), F.lit(":"), "bucket", F.lit(":"), "n", F.lit(";"))
    kept = F.collect_list(F.when(use, F.struct("bucket", item.alias("txt"))))
    return parts.groupBy(*by).agg(F.concat(F.count_if(use), F.lit(";"), text_of(kept)).alias("hist"))


def mode_count(parts: DataFrame, by: list[str]) -> DataFrame:
    """The one most frequent value, null on ties or without values."""
    live = parts.where(F.col("bucket").isNotNull())
    top = live.groupBy(*by).agg(F.max(F.struct("n", "bucket")).alias("t"), F.max("n").alias("m"))
    ties = live.join(top, by) if by else live.crossJoin(F.broadcast(top))
    ties = ties.where("n = m").groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.first("t").alias("t"))
    return ties.select(*by, F.when(F.col("k") == 1, F.concat(F.length("t.bucket"), F.lit(":"), "t.bucket", F.lit(":"), "t.n", F.lit(";"))).alias("hist"))


# The text form, read and written on its own: what a stored histogram is combined from.


def extension(name: str) -> str:
    """The text after the last dot; "no-ext" without one, or where the dot ends the name."""
    return name.rpartition(".")[2] if "." in name and not name.endswith(".") else "no-ext"


def count_log(values, base: int, count: int) -> tuple[int, int, int, int, dict[int, int]]:
    """Counts of floor(log_base v): texts and bytes count by their length, nulls as 0, negative numbers not at all."""
    if base < 2:
        raise ValueError(f"base {base}")
    below = above = 0
    found: dict[int, int] = {}
    for v in values:
        v = len(v) if isinstance(v, (str, bytes, bytearray)) else 0 if v is None or v != v else v
        if v < 0:
            continue
        if v < 1:
            below += 1
            continue
        k = 0
        while k < count and base ** (k + 1) <= v:
            k += 1
        if k >= count:
            above += 1
        else:
            found[k] = found.get(k, 0) + 1
    return base, count, below, above, found


def write_log(base: int, count: int, below: int, above: int, found: dict[int, int]) -> str:
    return f"{base};{count};{below};{above};" + "".join(f"{k}:{n};" for k, n in sorted(found.items()))


def read_log(text: str) -> tuple[int, int, int, int, dict[int, int]]:
    base, count, below, above, *items = text.rstrip(";").split(";")
    return int(base), int(count), int(below), int(above), {int(k): int(n) for k, n in (x.split(":") for x in items)}


def _pairs(texts: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in texts:
        for x in filter(None, t.split(";")):
            k, _, n = x.partition(":")
            out[k] = out.get(k, 0) + int(n)
    return out


def combine_log(texts: list[str]) -> str:
    """Empty histograms (0;0;0;0;) are passed over; others must agree in base and number of buckets."""
    parts = [p for p in map(read_log, texts) if p[:4] != (0, 0, 0, 0)]
    if not parts:
        return "0;0;0;0;"
    if len({p[:2] for p in parts}) > 1:
        raise ValueError("histograms of different bases or numbers of buckets")
    found: dict[int, int] = {}
    for p in parts:
        for k, n in p[4].items():
            found[k] = found.get(k, 0) + n
    return write_log(*parts[0][:2], sum(p[2] for p in parts), sum(p[3] for p in parts), found)


def combine_modes(texts: list[str]) -> str:
    return "".join(f"{k}:{n};" for k, n in sorted(_pairs(texts).items()))


def combine_times(texts: list[str]) -> str:
    """Reference times must agree; 0 stands for a histogram without rows."""
    refs = {t.split(";")[0] for t in texts} - {"0"}
    if len(refs) > 1:
        raise ValueError("histograms of different reference times")
    found = _pairs([t.split(";", 1)[1] for t in texts])
    return f"{refs.pop() if refs else 0};" + "".join(f"{k}:{n};" for k, n in sorted(found.items(), key=lambda x: int(x[0])))


def write_categories(found: dict[str, int]) -> str:
    return f"{len(found)};" + "".join(f"{len(k)}:{k}:{n};" for k, n in sorted(found.items()))


def read_categories(text: str) -> dict[str, int]:
    """Names may hold any character: each stands after its length."""
    _, _, rest = text.partition(";")
    out, at = {}, 0
    while at < len(rest):
        colon = rest.index(":", at)
        size = int(rest[at:colon])
        name = rest[colon + 1 : colon + 1 + size]
        end = rest.index(";", colon + 2 + size)
        out[name] = out.get(name, 0) + int(rest[colon + 2 + size : end])
        at = end + 1
    return out


def combine_categories(texts: list[str]) -> str:
    out: dict[str, int] = {}
    for t in texts:
        for k, n in read_categories(t).items():
            out[k] = out.get(k, 0) + n
    return write_categories(out)


def read_buckets(df: DataFrame, by: list[str], text: str, kind: str) -> DataFrame:
    """(by..., bucket, n) of serialised histograms of a column, to be merged with ``merge`` for groups of any size.

    ``kind``: log, mode, time or category.  Log histograms of one group must agree in base and number of buckets
    (bucket -1: below 1), time histograms in their reference time unless that is 0.
    """
    c = F.col(text)
    if kind == "category":
        find = F.udf(lambda t: list(read_categories(t).items()) if t else [], "array<struct<bucket: string, n: long>>", useArrow=True)
        return df.select(*by, F.explode(find(c)).alias("x")).select(*by, "x.bucket", "x.n")
    parts = F.split(F.rtrim(c, F.lit(";")), ";")
    skip = {"log": 4, "mode": 0, "time": 1}[kind]
    items = F.filter(F.slice(parts, skip + 1, 1 << 20), lambda x: x.contains(":"))
    pairs = F.transform(items, lambda x: F.struct((F.conv(F.split(x, ":")[0], 8, 10) if kind == "mode" else F.split(x, ":")[0]).cast("long").alias("bucket"), F.split(x, ":")[1].cast("long").alias("n")))
    if kind == "log":
        edge = F.array(F.struct(F.lit(-1).cast("long").alias("bucket"), parts[2].cast("long").alias("n")), F.struct(parts[1].cast("long").alias("bucket"), parts[3].cast("long").alias("n")))
        pairs = F.when(F.concat(parts[0], F.lit(";"), parts[1]) != "0;0", F.concat(edge, pairs)).otherwise(F.array().cast("array<struct<bucket: bigint, n: bigint>>"))
    return df.select(*by, F.explode(pairs).alias("x")).select(*by, "x.bucket", "x.n").where("n > 0")
