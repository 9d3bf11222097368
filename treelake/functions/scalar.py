"""Scalar functions on metadata as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain(x: Column, steps: list[tuple[int, str]], last: str) -> Column:
    """The label of the first upper bound that ``x`` is below."""
    out = F.lit(last)
    for bound, label in reversed(steps):
        out = F.when(x < F.lit(bound).cast("long"), label).otherwise(out)
    return out


def intcat(n: Column) -> Column:
    steps = [(1, "Zero"), *[(1000 ** (k + 1), s) for k, s in enumerate("OKMBTq")]]
    return F.when(n >= 0, chain(n, steps, "Q"))


def bytecat(n: Column) -> Column:
    steps = [(1, "Zero"), *[(1024 ** (k + 1), s) for k, s in enumerate("BKMGTP")]]
    return F.when(n >= 0, chain(n, steps, "E"))


_DAY = 86400


def agecat(t: Column, now: int) -> Column:
    steps = [(1, "Zero"), (60, "Secs"), (3600, "Mins"), (_DAY, "Hrs"), (7 * _DAY, "Days"), (30 * _DAY, "Wks"), (365 * _DAY, "Mos"), (3650 * _DAY, "Yrs")]
    return F.when(F.lit(now) >= t, chain(F.lit(now) - t, steps, "Decs")).when(t.isNotNull(), bad_timestamp(t))


def bad_timestamp(t: Column) -> Column:
    """An age of a time that lies ahead is an error, as is one of a negative number of seconds."""
    return F.raise_error(F.concat(F.lit("timestamp ahead of the clock: "), t.cast("string"))).cast("string")


AGE_UNITS = {"s": 1, "m": 60, "h": 3600, "d": _DAY, "w": 7 * _DAY, "M": 30 * _DAY, "y": 365 * _DAY, "D": 3650 * _DAY}


def epochtoage(t: Column, now: int, unit: str = "d") -> Column:
    """Whole units since a time; days where the unit is unknown.  A time ahead of the clock is an error."""
    return F.when(F.lit(now) >= t, quotient(F.lit(now) - t, AGE_UNITS.get(unit, _DAY))).when(t.isNotNull(), bad_timestamp(t).cast("long"))


def quotient(x: Column, y: Column | int) -> Column:
    """Integer quotient, exact for every long; null where ``y`` is 0."""
    y = (F.lit(y) if isinstance(y, int) else y).cast("long")
    return F.when(y != 0, F.call_function("div", x.cast("long"), y))


def quotient_up(x: Column, y: int) -> Column:
    """Quotient of numbers that aren't negative, rounded up, exact for every long."""
    x = x.cast("long")
    return quotient(x, y) + F.when(x % F.lit(y).cast("long") > 0, 1).otherwise(0).cast("long")


def unit_factor(unit: str) -> tuple[int, int, str]:
    """(count, factor, suffix) of a block size such as K, KiB, KB or 10M."""
    m = re.fullmatch(r"(\d*)([KMGTPE]?)(iB|B|)", unit)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"block size: {unit!r}")
    power = " KMGTPE".index(m[2]) if m[2] else 0
    return int(m[1] or 1), (1000 if m[3] == "B" else 1024) ** power, "" if m[1] else m[2] + m[3]


def blocksize(size: Column, unit: str) -> Column:
    """Blocks of a unit that hold a size, rounded up; the unit is printed unless a number leads it."""
    count, factor, suffix = unit_factor(unit)
    blocks = quotient_up(size, count * factor).cast("string")
    return F.concat(blocks, F.lit(suffix)) if suffix else blocks


def human_readable_size(n: Column) -> Column:
    out = F.concat(F.format_string("%.1f", F.bround(n / 1024**6, 1)), F.lit("E"))
    for k in range(5, 0, -1):
        out = F.when(n < F.lit(1024 ** (k + 1)), F.concat(F.format_string("%.1f", F.bround(n / 1024**k, 1)), F.lit(" KMGTP"[k]))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.1f", n.cast("double"))).otherwise(out)


def basename(path: Column) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path.isNull(), "").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def ext(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit(""))


def rpad(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, " "))


def modetotxt(mode: Column) -> Column:
    bit = lambda b: mode.bitwiseAND(F.lit(b)) != 0
    kind = mode.bitwiseAND(F.lit(0o170000))
    out = [F.when(kind == 0o040000, "d").when(kind == 0o120000, "l").otherwise("-")]
    for shift, special, low, high in ((6, 0o4000, "s", "S"), (3, 0o2000, "s", "S"), (0, 0o1000, "t", "T")):
        x = F.when(bit(special) & bit(1 << shift), low).when(bit(special), high).when(bit(1 << shift), "x").otherwise("-")
        out += [F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-"), x]
    return F.concat(*out)


_DATE = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "h": "MMM", "a": "EEE", "B": "MMMM", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "R": "HH:mm", "D": "MM/dd/yy", "I": "hh", "p": "a", "z": "xx", "Z": "zzz", "r": "hh:mm:ss a",
}


def strftime(fmt: str, t: Column) -> Column:
    """C format of epoch seconds in the session time zone; a directive that C doesn't know is a ValueError."""
    at = F.timestamp_seconds(t)
    show = lambda p: F.date_format(at, p)
    special = {
        "%": F.lit("%"), "n": F.lit("\n"), "t": F.lit("\t"), "s": t.cast("string"),
        "e": F.lpad(show("d"), 2, " "), "k": F.lpad(show("H"), 2, " "), "l": F.lpad(show("h"), 2, " "),
        "C": F.lpad(quotient(F.year(at), 100).cast("string"), 2, "0"), "u": (F.weekday(at) + 1).cast("string"), "w": (F.dayofweek(at) - 1).cast("string"),
        "V": F.lpad(F.weekofyear(at).cast("string"), 2, "0"),
        "G": F.extract(F.lit("YEAROFWEEK"), at).cast("string"),
        "U": F.lpad(quotient(F.dayofyear(at) + 7 - F.dayofweek(at), 7).cast("string"), 2, "0"),
        "W": F.lpad(quotient(F.dayofyear(at) + 6 - F.weekday(at), 7).cast("string"), 2, "0"),
        "c": F.concat(show("EEE MMM "), F.lpad(show("d"), 2, " "), show(" HH:mm:ss yyyy")),
        "x": show("MM/dd/yy"), "X": show("HH:mm:ss"),
    }
    parts = []
    for p in re.findall(r"%.|[^%]+|%$", fmt, re.DOTALL):
        if p[0] != "%" or p == "%":
            parts.append(F.lit(p))
        elif p[1] in _DATE:
            parts.append(show(_DATE[p[1]]))
        elif p[1] in special:
            parts.append(special[p[1]])
        else:
            raise ValueError(f"time format: {p!r}")
    return F.concat(*parts) if parts else F.lit("")


def rpath(dir_path: Column, name: Column | None = None) -> Column:
    return F.concat_ws("/", F.nullif(dir_path, F.lit("")), name) if name is not None else dir_path


def spath(prefix: str, dir_path: Column, name: Column | None = None) -> Column:
    return F.concat_ws("/", F.lit(prefix), F.nullif(dir_path, F.lit("")), *([name] if name is not None else []))


def stdevs(x: Column) -> Column:
    return F.stddev_samp(F.coalesce(x, F.lit(0)))


def stdevp(x: Column) -> Column:
    return F.when(F.count(F.lit(1)) >= 2, F.stddev_pop(F.coalesce(x, F.lit(0))))


def stdev_from_parts(sq: Column, s: Column, n: Column, sample: bool) -> Column:
    top = n.cast("double") * sq - s.cast("double") * s
    return F.sqrt(top / (n.cast("double") * (n - 1 if sample else n)))


def median(x: Column) -> Column:
    """Exact median of a group, null without rows; fractions are kept.  ``operators.analyses.medians`` is for large groups."""
    return F.percentile(x, 0.5)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda acc, v: acc + v))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex of a shell pattern with *, ? and [..]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"
