"""Extensions of indexing and querying: columns, filters and functions that a site adds.

A plugin changes DataFrames before anything runs, so its work is part of the plan; there are no callbacks a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a directory's or file's action may be.
PROCESS, SKIP, PRUNE = "process", "skip", "prune"


class Plugin:
    """Override what is wanted.  ``start`` and ``stop`` run once on the driver, ``register`` adds names for spark.sql."""

    def start(self, spark: SparkSession) -> None: ...

    def stop(self, spark: SparkSession) -> None: ...

    def register(self, spark: SparkSession) -> None: ...

    def transform_entries(self, entries: DataFrame) -> DataFrame:
        return entries

    def transform_dirs(self, dirs: DataFrame) -> DataFrame:
        return dirs

    def dir_action(self) -> Column:
        """PROCESS, SKIP (its own rows are left out) or PRUNE (all below it as well), over a directory's columns."""
        return F.lit(PROCESS)

    def file_action(self) -> Column:
        """PROCESS or SKIP, over an entry's columns."""
        return F.lit(PROCESS)


def apply_plugins(spark: SparkSession, entries: DataFrame, dirs: DataFrame, plugins: list[Plugin]) -> tuple[DataFrame, DataFrame]:
    """(entries, dirs) after the plugins, in their order: actions first, then transformations."""
    from ..operators.summary import closure

    for p in plugins:
        p.start(spark)
        p.register(spark)
        marked = dirs.withColumn("__action", p.dir_action())
        pruned = marked.where(F.col("__action") == PRUNE).select(F.col("path").alias("ancestor")).distinct()
        marked = closure(marked).join(pruned.withColumn("__hit", F.lit(1)), "ancestor", "left").groupBy("inode").agg(F.max("__hit").alias("__hit"), F.first("__action").alias("__action"))
        keep = marked.where(F.col("__hit").isNull() & (F.col("__action") == PROCESS)).select("inode")
        dirs = dirs.join(keep, "inode", "left_semi")
        entries = entries.join(keep.withColumnRenamed("inode", "pinode"), "pinode", "left_semi").where(p.file_action() == PROCESS)
        entries, dirs = p.transform_entries(entries), p.transform_dirs(dirs)
    for p in reversed(plugins):
        p.stop(spark)
    return entries, dirs


class SnapshotDirs(Plugin):
    """Leaves out snapshot folders with all below them."""

    def __init__(self, names: tuple[str, ...] = (".snapshot", ".snapshots", ".zfs")):
        self.names = names

    def dir_action(self) -> Column:
        return F.when(F.substring_index("path", "/", -1).isin(*self.names), PRUNE).otherwise(PROCESS)


class Stripes(Plugin):
    """Takes a stripe count and a pool from extended attributes into the site's own columns."""

    def __init__(self, count: str = "user.stripe_count", pool: str = "user.pool"):
        self.count, self.pool = count, pool

    def transform_entries(self, entries: DataFrame) -> DataFrame:
        value = lambda n: F.get(F.filter("xattrs", lambda x: x["name"] == n), F.lit(0))["value"]
        return entries.withColumns({"ossint1": F.coalesce(value(self.count).try_cast("bigint"), F.col("ossint1")), "osstext1": F.coalesce(value(self.pool), F.col("osstext1"))})


class Collections(Plugin):
    """collection_name(path) and collection_uuid(path): the first two levels of a path name a collection."""

    def register(self, spark: SparkSession) -> None:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION collection_name(path STRING) RETURNS STRING RETURN nullif(substring_index(path, '/', 2), '')")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION collection_uuid(path STRING) RETURNS STRING RETURN regexp_replace(substring(sha2(collection_name(path), 256), 1, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')")


#: What is taken for personal data: label -> pattern.
PII = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){12,15}\d\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "PHONE_NUMBER": r"(?<![\w.-])\+?\d{1,3}?[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "URL": r"\bhttps?://[^\s<>\"']+",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
}


class Pii(Plugin):
    """pii_found(text): labels and numbers of what PII finds; pii_hide(text): the text with each replaced by <LABEL>."""

    def register(self, spark: SparkSession) -> None:
        hide, found = "text", []
        for label, pattern in PII.items():
            quoted = pattern.replace("'", "\\x27")
            hide = f"regexp_replace({hide}, r'{quoted}', '<{label}>')"
            found.append(f"struct('{label}' as label, regexp_count(text, r'{quoted}') as n)")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_hide(text STRING) RETURNS STRING RETURN {hide}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_found(text STRING) RETURNS ARRAY<STRUCT<label: STRING, n: INT>> RETURN filter(array({', '.join(found)}), x -> x.n > 0)")
