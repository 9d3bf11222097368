"""printf-like formats of find and stat, and the columns of long listings, as Column expressions.

A format is taken apart on the driver; what reaches the executors is one concatenation of native functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import modetotxt, quotient, strftime

_WIDTH = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)")
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}


def padded(text: Column, width: str, number: bool = False) -> Column:
    """``text`` under a printf width such as 8, -8, 08, +8 or .3: numbers may be signed and filled with zeros, strings
    are cut to a precision.  Longer text stays whole."""
    m = re.fullmatch(r"([+-]?)(\d*)(?:\.(\d*))?", width)
    if m is None:
        raise ValueError(f"width: {width!r}")
    sign, digits, precision = m[1], m[2], m[3]
    zero, wide = digits.startswith("0") and number and sign != "-", int(digits or 0)
    if precision is not None and not number:
        text = F.substring(text, 1, int(precision or 0))
    if number:
        minus = F.when(text.startswith("-"), "-").otherwise("+" if sign == "+" else "")
        bare = F.regexp_replace(text, "^-", "")
        least = max(int(precision or 0), 0)
        if zero:
            bare = F.when(F.length(bare) + F.length(minus) < wide, F.lpad(bare, F.lit(wide) - F.length(minus), F.lit("0"))).otherwise(bare)
        elif least:
            bare = F.when(F.length(bare) < least, F.lpad(bare, least, "0")).otherwise(bare)
        text = F.concat(minus, bare)
    if wide == 0:
        return text
    return F.when(F.length(text) >= wide, text).otherwise(F.rpad(text, wide, " ") if sign == "-" else F.lpad(text, wide, " "))


def octal(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("0"))


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _name(name: str, number: str) -> Column:
    return F.coalesce(F.col(name), F.col(number).cast("string"))


def find_directives() -> dict[str, tuple[Column, bool, bool]]:
    """Directive -> (value, is a number, takes a width) of find's -printf, over the columns of ``frontends.listing``."""
    c = F.col
    used = c("blocks") * c("blksize")
    number = lambda x: (_number(x), True, True)
    text = lambda x: (_text(x), False, True)
    return {
        "a": number(c("atime")), "b": number(quotient(used, 512)), "c": number(c("ctime")), "d": number(c("level") + F.when(c("type") == "d", 0).otherwise(1)), "D": text(F.lit("-")),
        "f": text(c("name")), "g": (_name("group", "gid"), False, False), "G": number(c("gid")), "h": text(c("path")), "H": text(c("start")), "i": number(c("inode")),
        "k": number(quotient(used, 1024)), "l": text(c("linkname")), "m": (octal(c("mode").bitwiseAND(F.lit(0o777))), True, True), "M": text(modetotxt(c("mode"))), "n": number(c("nlink")),
        "p": (c("path"), False, False), "P": text(F.substring(c("path"), F.length("start") + 2, F.length("path"))), "s": number(c("size")), "S": number(quotient(used, c("size"))),
        "t": number(c("mtime")), "u": (_name("user", "uid"), False, False), "U": number(c("uid")), "y": text(c("type")),
    }


def find_printf(fmt: str) -> Column:
    """find's -printf.  A directive that isn't known stands for itself; a lone % at the end for nothing; \\c ends the output."""
    known, out, plain, i = find_directives(), [], "", 0
    while i < len(fmt):
        if fmt[i] == "\\" and i + 1 < len(fmt):
            c = fmt[i + 1]
            if c == "c":
                break
            if c in _SIMPLE:
                plain, i = plain + _SIMPLE[c], i + 2
            elif c == "0":
                plain, i = plain + "\0", i + 2
            elif m := re.match(r"[1-7][0-7]{0,2}", fmt[i + 1 :]):
                plain, i = plain + chr(int(m[0], 8)), i + 1 + len(m[0])
            else:
                plain, i = plain + "\\" + c, i + 2
        elif fmt[i] == "%":
            m = _WIDTH.match(fmt, i + 1)
            width = m[0] if m else ""
            at = i + 1 + len(width)
            if at >= len(fmt):
                break
            if fmt[at] == "%":
                plain, i = plain + "%", at + 1
            elif fmt[at] in known:
                value, number, wide = known[fmt[at]]
                out += [F.lit(plain), padded(value, width, number) if wide else value]
                plain, i = "", at + 1
            else:
                plain, i = plain + fmt[i:at] + fmt[at], at + 1
        else:
            plain, i = plain + fmt[i], i + 1
    return F.concat(*out, F.lit(plain))


UNKNOWN = "UNKNOWN"


def stat_directives() -> dict[str, tuple[Column, bool]]:
    """Directive -> (value, is a number) of stat's format, over the columns of ``frontends.listing``."""
    c = F.col
    full = lambda t: strftime("%F %T %z", t)
    born = F.coalesce(c("crtime"), F.lit(0)) != 0
    quoted = F.concat(F.lit("'"), c("path"), F.lit("'"))
    return {
        "a": (octal(c("mode").bitwiseAND(F.lit(0o777))), True), "A": (modetotxt(c("mode")), False), "b": (_text(c("blocks")), False), "B": (_text(c("blksize")), False), "C": (F.lit(""), False),
        "d": (F.lit("?"), False), "D": (F.lit("?"), False), "f": (F.lower(F.hex(c("mode"))), True), "F": (F.when(c("type") == "f", "regular file").when(c("type") == "l", "symbolic link").when(c("type") == "d", "directory").otherwise(""), False),
        "g": (_text(c("gid")), False), "G": (F.coalesce("group", F.lit(UNKNOWN)), False), "h": (_text(c("nlink")), False), "i": (_text(c("inode")), False), "m": (F.lit(" "), False), "n": (c("path"), False),
        "N": (F.when(c("type") == "l", F.concat(quoted, F.lit(" -> '"), _text(c("linkname")), F.lit("'"))).otherwise(quoted), False), "o": (_text(c("blksize")), False), "s": (_text(c("size")), False),
        "t": (F.lit("0"), True), "T": (F.lit("0"), True), "u": (_text(c("uid")), False), "U": (F.coalesce("user", F.lit(UNKNOWN)), False),
        "w": (F.when(born, full(c("crtime"))).otherwise("-"), False), "W": (F.when(born, c("crtime").cast("string")).otherwise("0"), False),
        "x": (full(c("atime")), False), "X": (_text(c("atime")), False), "y": (full(c("mtime")), False), "Y": (_text(c("mtime")), False), "z": (full(c("ctime")), False), "Z": (_text(c("ctime")), False),
    }


def stat_format(fmt: str, escapes: bool = False) -> Column:
    """stat's --format, or with ``escapes`` its --printf.  A directive that isn't known gives "?"."""
    known, out, plain, i = stat_directives(), [], "", 0
    while i < len(fmt):
        if escapes and fmt[i] == "\\" and i + 1 < len(fmt):
            c, more = fmt[i + 1], re.match(r"x[0-9A-Fa-f]{1,2}|[0-7]{1,3}", fmt[i + 1 :])
            if more:
                code = more[0]
                plain, i = plain + chr(int(code[1:], 16) if code[0] == "x" else int(code, 8)), i + 1 + len(code)
            else:
                plain, i = plain + {**_SIMPLE, "e": "\x1b", "'": "'", '"': '"', "?": "?"}.get(c, "\\" + c), i + 2
        elif fmt[i] == "%":
            m = re.match(r"[+-]?\d*(?:\.\d*)?", fmt[i + 1 :])
            at = i + 1 + len(m[0])
            if at >= len(fmt):
                plain, i = plain + fmt[i:], len(fmt)
            elif fmt[at] == "%":
                plain, i = plain + "%", at + 1
            else:
                value, number = known.get(fmt[at], (F.lit("?"), False))
                out += [F.lit(plain), padded(value, m[0], number)]
                plain, i = "", at + 1
        else:
            plain, i = plain + fmt[i], i + 1
    return F.concat(*out, F.lit(plain))


def _owner(name: str, letter: str) -> str:
    return f"{name}: (%5{letter}/%8{letter.upper()})"


#: What stat prints without a format.
STAT_DEFAULT = "\n".join([
    "  File: %N", "  Size: %-10s\tBlocks: %-10b IO Block: %-6o %F", "Device: %d\tInode: %-10i  Links: %h", f"Access: (%04a/%10A)  {_owner('Uid', 'u')}   {_owner('Gid', 'g')}",
    *(f"{what}: %{letter}" for what, letter in (("Access", "x"), ("Modify", "y"), ("Change", "z"), (" Birth", "w"))),
])

TIME_STYLES = {"full-iso": "%F %T %z", "long-iso": "%F %T", "iso": "%m-%d %R"}
#: Half of a year of 365.2425 days, in seconds.
HALF_YEAR = 15_778_476


def time_style(t: Column, style: str, now: int) -> Column:
    """A time as long listings print it: by a named style, a format after "+", or ("locale") the day with the hour for
    the last six months and with the year before that."""
    if style.startswith("+"):
        return strftime(style[1:], t)
    if style == "locale":
        return F.when(F.lit(now) - t > HALF_YEAR, strftime("%b  %e  %Y", t)).otherwise(strftime("%b  %e %H:%M", t))
    if style not in TIME_STYLES:
        raise ValueError(f"time style: {style!r}")
    return strftime(TIME_STYLES[style], t)
