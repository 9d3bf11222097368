"""Names for spark.sql: scalar functions as SQL expressions that Catalyst inlines, aggregates over Arrow batches.

The scalars are temporary SQL functions, so a query that calls them stays inside generated code.  The text forms of
histograms are aggregates on a group's values in memory; ``functions.hist`` counts groups of any size.
"""

from __future__ import annotations

import socket
import subprocess

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import hist as H


def _steps(x: str, steps: list[tuple[int, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b}L THEN '{v}'" for b, v in steps if b < 1 << 63) + f" ELSE '{last}' END"


_NONE = "raise_error(concat('not a number that can be told: ', cast({x} as string)))"
_AGE = [(1, "Zero"), (60, "Secs"), (3600, "Mins"), (86400, "Hrs"), (604800, "Days"), (2592000, "Wks"), (31536000, "Mos"), (315360000, "Yrs")]
_BIT = "CASE WHEN (mode & {s}) <> 0 AND (mode & {x}) <> 0 THEN '{a}' WHEN (mode & {s}) <> 0 THEN '{b}' WHEN (mode & {x}) <> 0 THEN 'x' ELSE '-' END"


def _mode() -> str:
    out = ["CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 40960 THEN 'l' ELSE '-' END"]
    for shift, special, a, b in ((6, 2048, "s", "S"), (3, 1024, "s", "S"), (0, 512, "t", "T")):
        out += [f"IF((mode & {4 << shift}) <> 0, 'r', '-')", f"IF((mode & {2 << shift}) <> 0, 'w', '-')", _BIT.format(s=special, x=1 << shift, a=a, b=b)]
    return f"concat({', '.join(out)})"


def _human() -> str:
    parts = ["WHEN n < 1024 THEN format_string('%.1f', cast(n as double))"]
    parts += [f"WHEN n < {1024 ** (k + 1)} THEN concat(format_string('%.1f', bround(n / {1024**k}D, 1)), '{c}')" for k, c in enumerate("KMGTP", 1)]
    return "CASE " + " ".join(parts) + f" ELSE concat(format_string('%.1f', bround(n / {1024**6}D, 1)), 'E') END"


#: name -> (parameters, result, expression)
SQL_FUNCTIONS = {
    "intcat": ("n BIGINT", "STRING", f"CASE WHEN n < 0 THEN {_NONE.format(x='n')} WHEN n IS NOT NULL THEN {_steps('n', [(1, 'Zero'), *[(1000 ** (k + 1), c) for k, c in enumerate('OKMBTq')]], 'Q')} END"),
    "bytecat": ("n BIGINT", "STRING", f"CASE WHEN n < 0 THEN {_NONE.format(x='n')} WHEN n IS NOT NULL THEN {_steps('n', [(1, 'Zero'), *[(1024 ** (k + 1), c) for k, c in enumerate('BKMGTP')]], 'E')} END"),
    "agecat": ("t BIGINT, clock BIGINT", "STRING", f"CASE WHEN t > clock THEN {_NONE.format(x='t')} WHEN t IS NOT NULL THEN {_steps('(clock - t)', _AGE, 'Decs')} END"),
    "epochtoage": ("t BIGINT, unit STRING, clock BIGINT", "BIGINT", f"CASE WHEN t > clock THEN cast({_NONE.format(x='t')} as bigint) ELSE (clock - t) div CASE unit WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'w' THEN 604800 WHEN 'M' THEN 2592000 WHEN 'y' THEN 31536000 WHEN 'D' THEN 315360000 ELSE 86400 END END"),
    "human_readable_size": ("n BIGINT", "STRING", _human()),
    "modetotxt": ("mode BIGINT", "STRING", _mode()),
    "basename": ("path STRING", "STRING", "CASE WHEN path IS NULL THEN '' WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE substring_index(regexp_replace(path, '/+$', ''), '/', -1) END"),
    "ext": ("name STRING", "STRING", r"nullif(regexp_extract(name, r'\.([^.]+)\z', 1), '')"),
    "pad_right": ("s STRING, n INT", "STRING", "CASE WHEN length(s) >= n THEN s ELSE rpad(s, n, ' ') END"),
    "rpath": ("sname STRING, sroll INT, name STRING", "STRING", "concat_ws('/', nullif(sname, ''), name)"),
    "spath": ("prefix STRING, sname STRING, sroll INT, name STRING", "STRING", "concat_ws('/', prefix, nullif(sname, ''), name)"),
    "subdirs": ("srollsubdirs BIGINT, sroll INT", "BIGINT", "srollsubdirs"),
    "thread_id": ("", "INT", "spark_partition_id()"),
    "stdev_from_parts": ("sq DOUBLE, s DOUBLE, n DOUBLE, sample INT", "DOUBLE", "sqrt((n * sq - s * s) / (n * (n - IF(sample <> 0, 1, 0))))"),
    "l2_distance": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (p, q) -> (cast(p as double) - q) * (cast(p as double) - q)), 0D, (acc, v) -> acc + v))"),
}


def _sizes(unit: str) -> tuple[int, str]:
    from .scalar import unit_factor

    count, factor, suffix = unit_factor(unit)
    return count * factor, suffix


def register(spark: SparkSession, *, clock: int | None = None, start: str = "", users: dict[int, str] | None = None, groups: dict[int, str] | None = None, run_commands: bool = False) -> list[str]:
    """Register every function under its name and return the names.

    ``clock``: the time that one-argument ages count from (else the query's start); ``users`` and ``groups``: names of
    bounded numbers of owners, others stand for themselves; ``run_commands`` also registers strop, intop and blobop,
    which run shell commands on the executors and are meant for trusted queries only.
    """
    names = []
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
        names.append(name)
    now = str(clock) if clock is not None else "unix_timestamp()"
    extra = {
        "age_of": ("t BIGINT", "STRING", f"agecat(t, {now})"), "age_in": ("t BIGINT, unit STRING", "BIGINT", f"epochtoage(t, unit, {now})"),
        "hostname": ("", "STRING", "'" + socket.gethostname().replace("'", "''") + "'"), "starting_point": ("", "STRING", "'" + start.replace("'", "''") + "'"),
    }
    for name, table in (("uidtouser", users), ("gidtogroup", groups)):
        pairs = ", ".join(f"{int(k)}L, '" + v.replace("'", "''") + "'" for k, v in (table or {}).items())
        known = f"element_at(map({pairs}), id)" if pairs else "cast(null as string)"
        extra[name] = ("id BIGINT", "STRING", f"coalesce({known.replace('element_at', 'try_element_at')}, cast(id as string))")
    for name, (params, result, body) in extra.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
        names.append(name)

    @F.pandas_udf("string")
    def blocksize(size: pd.Series, unit: pd.Series) -> pd.Series:
        out = []
        for s, u in zip(size, unit):
            n, suffix = _sizes(u)
            out.append(None if pd.isna(s) else f"{-(-int(s) // n)}{suffix}")
        return pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def c_strftime(fmt: pd.Series, t: pd.Series) -> pd.Series:
        at = pd.to_datetime(t, unit="s", utc=True)
        return pd.Series([None if pd.isna(x) else x.strftime(f) for f, x in zip(fmt, at)], dtype=object)

    made = {"blocksize": blocksize, "c_strftime": c_strftime, **aggregates()}
    if run_commands:
        made |= commands()
    for name, f in made.items():
        spark.udf.register(name, f)
        names.append(name)
    return sorted(names)


def commands() -> dict:
    """strop, intop, blobop: first line as text, as a number, and all bytes of a shell command's output."""

    def run(c: str | None) -> bytes | None:
        return None if c is None else subprocess.run(c, shell=True, capture_output=True, check=False).stdout  # noqa: S602

    @F.pandas_udf("string")
    def strop(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else run(x).split(b"\n")[0].decode("utf-8", "replace"))

    @F.pandas_udf("long")
    def intop(c: pd.Series) -> pd.Series:
        def one(x):
            text = b"" if x is None else run(x).strip()
            return int(text.split()[0]) if text[:20].strip().lstrip(b"-").split(b"\n")[0].isdigit() else None

        return c.map(one).astype("Int64")

    @F.pandas_udf("binary")
    def blobop(c: pd.Series) -> pd.Series:
        return c.map(run)

    return {"strop": strop, "intop": intop, "blobop": blobop}


def aggregates() -> dict:
    """stdevs, stdevp, median_of, and the histograms in their text form with their combiners."""

    @F.pandas_udf("double")
    def stdevs(x: pd.Series) -> float:
        return None if len(x) < 2 else float(x.fillna(0).astype(float).std(ddof=1))

    @F.pandas_udf("double")
    def stdevp(x: pd.Series) -> float:
        return None if len(x) < 2 else float(x.fillna(0).astype(float).std(ddof=0))

    @F.pandas_udf("double")
    def median_of(x: pd.Series) -> float:
        return None if x.dropna().empty else float(x.dropna().astype(float).median())

    @F.pandas_udf("string")
    def log_hist(x: pd.Series, base: pd.Series, count: pd.Series) -> str:
        return H.write_log(*H.count_log(x, int(base.iloc[0]), int(count.iloc[0]))) if len(x) else "0;0;0;0;"

    @F.pandas_udf("string")
    def mode_hist(x: pd.Series) -> str:
        return "".join(f"{m:03o}:{n};" for m, n in sorted((x.dropna().astype(int) & 0o777).value_counts().items()))

    @F.pandas_udf("string")
    def time_hist(x: pd.Series, ref: pd.Series) -> str:
        if not len(x):
            return "0;"
        r = int(ref.iloc[0])
        found = (r - x.fillna(0).astype("int64")).map(lambda d: next((a for a in H.AGES if d < a), 630720001)).value_counts()
        return f"{r};" + "".join(f"{a}:{n};" for a, n in sorted(found.items()))

    def categories(x: pd.Series, keep1: pd.Series) -> str:
        found = x.dropna().value_counts()
        if len(keep1) and not int(keep1.iloc[0]):
            found = found[found > 1]
        return H.write_categories({str(k): int(n) for k, n in found.items()})

    @F.pandas_udf("string")
    def category_hist(x: pd.Series, keep1: pd.Series) -> str:
        return categories(x, keep1)

    @F.pandas_udf("string")
    def extension_hist(x: pd.Series, keep1: pd.Series) -> str:
        return categories(x.dropna().map(H.extension), keep1)

    @F.pandas_udf("string")
    def mode_count(x: pd.Series) -> str:
        found = x.dropna().value_counts()
        if found.empty or (found == found.iloc[0]).sum() > 1:
            return None
        return f"{len(str(found.index[0]))}:{found.index[0]}:{int(found.iloc[0])};"

    def combiner(f):
        @F.pandas_udf("string")
        def combine(x: pd.Series) -> str:
            return f([t for t in x if t is not None])

        return combine

    out = {f.__name__: f for f in (stdevs, stdevp, median_of, log_hist, mode_hist, time_hist, category_hist, extension_hist, mode_count)}
    return out | {"log_hist_combine": combiner(H.combine_log), "mode_hist_combine": combiner(H.combine_modes), "time_hist_combine": combiner(H.combine_times), "category_hist_combine": combiner(H.combine_categories), "extension_hist_combine": combiner(H.combine_categories)}
