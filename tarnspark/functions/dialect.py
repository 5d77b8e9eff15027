"""Functions of the admitted SQL surface whose meaning differs from Spark's function of that name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower(x: str | Column) -> Column:
    """Only A-Z are folded."""
    return F.translate(_c(x), _UPPER, _LOWER)


def upper(x: str | Column) -> Column:
    return F.translate(_c(x), _LOWER, _UPPER)


def like(x: str | Column, pattern: str) -> Column:
    """LIKE, blind to case."""
    return _c(x).ilike(pattern)


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as a regular expression: * and ? and [sets], a leading ^ negating a set."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            negated = pattern[i + 1] == "^"
            body = pattern[i + 1 + negated : end]
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(x: str | Column, pattern: str) -> Column:
    return _c(x).rlike(glob_regex(pattern))


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def total(x: str | Column) -> Column:
    """Sum that is 0.0 over nothing."""
    return F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0))


def group_concat(x: str | Column, sep: str = ",") -> Column:
    """Non-null texts joined in their own order, so that the result does not depend on partitions."""
    return F.array_join(F.array_sort(F.collect_list(_c(x).cast("string"))), sep)


def substr(x: str | Column, start: int, length: int | None = None) -> Column:
    """Position 0 stands before the first character, so that it uses up one of the length."""
    x = _c(x)
    if start == 0 and length is not None:
        return F.substring(x, 1, max(0, length - 1))
    return F.substring(x, start, 2**31 - 1 if length is None else length)


def trim(x: str | Column, chars: str = " ") -> Column:
    return rtrim(ltrim(x, chars), chars)


def _set(chars: str) -> str:
    return "[" + re.sub(r"([\\\[\]&^-])", r"\\\1", chars) + "]"


def ltrim(x: str | Column, chars: str = " ") -> Column:
    return F.regexp_replace(_c(x), f"^{_set(chars)}+", "") if chars else _c(x)


def rtrim(x: str | Column, chars: str = " ") -> Column:
    return F.regexp_replace(_c(x), f"{_set(chars)}+$", "") if chars else _c(x)


def concat(*xs: Column) -> Column:
    """Null counts as an empty text."""
    return F.concat_ws("", *xs)


def divide(a: Column, b: Column) -> Column:
    """Null on a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def sqrt(x: Column) -> Column:
    """Null below zero."""
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column, y: Column | None = None) -> Column:
    """One argument: base 10. Two: base, value."""
    return F.log10(x) if y is None else F.log(y) / F.log(x)


def mod(a: Column, b: Column) -> Column:
    """A real number; null on a zero divisor."""
    b = b.cast("double")
    return F.when(b != 0, F.try_mod(a.cast("double"), b))


def _all_known(xs: tuple[Column, ...], value: Column) -> Column:
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, value)


def scalar_max(*xs: Column) -> Column:
    """The greatest; null if any is null."""
    return _all_known(xs, F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    return _all_known(xs, F.least(*xs))


def typeof(x: Column) -> Column:
    t = F.typeof(x)
    named = F.when(t.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer").when(t.isin("float", "double") | t.startswith("decimal"), "real").when(t == "binary", "blob").otherwise("text")
    return F.when(x.isNull(), "null").otherwise(named)


# --- dates: text in ISO form, null on what is no date -------------------------------------------------

_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "'%'"}


def _ts(t: str | Column) -> Column:
    return _c(t).try_cast("timestamp")


def shifted(ts: Column, modifier: str) -> Column:
    """One date modifier: '+N days|months|years|hours|minutes|seconds' or 'start of day|month|year'.

    Months and years run over into the next month where the day does not exist there.
    """
    m = re.fullmatch(r"start of (day|month|year)", modifier)
    if m:
        return F.date_trunc(m[1], ts)
    m = re.fullmatch(r"([+-]?\d+) (day|month|year|hour|minute|second)s?", modifier)
    if not m:
        raise ValueError(f"unknown date modifier: {modifier!r}")
    n, unit = int(m[1]), m[2]
    if unit in ("month", "year"):
        months = n * (12 if unit == "year" else 1)
        first = F.date_trunc("month", ts)
        return first + F.make_ym_interval(F.lit(0), F.lit(months)) + (ts - first)
    seconds = n * {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(seconds * 1_000_000))


def _moved(t: str | Column, modifiers: tuple[str, ...]) -> Column:
    ts = _ts(t)
    for m in modifiers:
        ts = shifted(ts, m)
    return ts


def date(t: str | Column, *modifiers: str) -> Column:
    return F.date_format(_moved(t, modifiers), "yyyy-MM-dd")


def time(t: str | Column, *modifiers: str) -> Column:
    return F.date_format(_moved(t, modifiers), "HH:mm:ss")


def datetime(t: str | Column, *modifiers: str) -> Column:
    return F.date_format(_moved(t, modifiers), "yyyy-MM-dd HH:mm:ss")


def julianday(t: str | Column, *modifiers: str) -> Column:
    return F.unix_micros(_moved(t, modifiers)) / 86400e6 + 2440587.5


def unixepoch(t: str | Column, *modifiers: str) -> Column:
    return F.unix_seconds(_moved(t, modifiers))


def strftime(fmt: str, t: str | Column, *modifiers: str) -> Column:
    ts = _moved(t, modifiers)
    out = []
    for part in re.findall(r"%.|[^%]+", fmt):
        if part == "%w":
            out.append((F.dayofweek(ts) - 1).cast("string"))
        elif part == "%s":
            out.append(F.unix_seconds(ts).cast("string"))
        elif part == "%J":
            out.append((F.unix_micros(ts) / 86400e6 + 2440587.5).cast("string"))
        elif part == "%W":
            out.append(F.lpad(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string"), 2, "0"))
        elif part in _FORMATS:
            out.append(F.date_format(ts, _FORMATS[part]))
        elif part.startswith("%"):
            raise ValueError(f"unknown date format: {part}")
        else:
            out.append(F.lit(part))
    return F.concat(*out)


#: The function names that statements may call, by family.
AGGREGATES = ("count", "sum", "avg", "total", "min", "max", "group_concat", "string_agg")
WINDOWS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value")
SCALARS = (
    "abs", "coalesce", "ifnull", "nullif", "iif", "length", "lower", "upper", "substr", "substring", "trim", "ltrim", "rtrim", "replace", "instr", "round", "typeof", "like", "glob",
    "concat", "concat_ws", "ceil", "ceiling", "floor", "trunc", "sqrt", "pow", "power", "exp", "ln", "log", "log10", "log2", "mod", "sign",
    "date", "time", "datetime", "julianday", "strftime", "unixepoch",
)
ADMITTED = frozenset(AGGREGATES + WINDOWS + SCALARS)
