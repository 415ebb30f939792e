"""Scalar Column functions.  Everything here is a built-in Spark expression, so it stays in
whole-stage codegen; nothing runs per row in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced).
# Header hint words, main rule:
HEADER_HINTS = ("id", "sno", "s.no", "date", "timestamp", "name", "category", "target", "label", "value", "type")
# Header hint words, variant rule (its tokens also fold '-' and '/' into '_'):
HEADER_HINTS_VARIANT = ("sno", "s_no", "s_no_", "s_no.", "s.no", "id", "date", "name", "value", "type")
# Text that means "missing" after trimming:
NULL_TOKENS = ("", "nan", "None", "null")
# Text that a delimited-file reader takes for "missing" (the defaults of pandas):
READER_NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                      "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Name fragments of identifier-like text columns dropped before generation:
ID_TERMS = ("id", "uuid", "guid", "key", "index", "hash")
# Name fragments that suggest a time column:
TIME_NAME_TERMS = ("date", "time", "timestamp")
# ---------------------------------------------------------------------------------------

# A decimal number: optional sign, digits with optional point and digits, or point and
# digits, optional exponent.  Guards ``cast`` against '1d', '5f', 'nan', 'inf'.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date/time formats tried for text columns, in order (first wins on equal parse rates).
# Every one contains a separator, so plain digit strings are never taken for dates.  Each
# has a cheap shape test so the (exception-driven) parser only sees plausible strings.
_D2 = r"\d{1,2}"
DATETIME_SHAPES = {
    "yyyy-M-d": rf"^\d{{4}}-{_D2}-{_D2}$",
    "yyyy-M-d H:m:s": rf"^\d{{4}}-{_D2}-{_D2} {_D2}:{_D2}:{_D2}$",
    "yyyy-M-d'T'H:m:s": rf"^\d{{4}}-{_D2}-{_D2}T{_D2}:{_D2}:{_D2}$",
    "yyyy-M-d H:m:s.SSSSSS": rf"^\d{{4}}-{_D2}-{_D2} {_D2}:{_D2}:{_D2}\.\d{{1,6}}$",
    "yyyy-M-d'T'H:m:s.SSSSSS": rf"^\d{{4}}-{_D2}-{_D2}T{_D2}:{_D2}:{_D2}\.\d{{1,6}}$",
    "yyyy-M-d H:m": rf"^\d{{4}}-{_D2}-{_D2} {_D2}:{_D2}$",
    "yyyy/M/d": rf"^\d{{4}}/{_D2}/{_D2}$",
    "M/d/yyyy": rf"^{_D2}/{_D2}/\d{{4}}$",
    "d-M-yyyy": rf"^{_D2}-{_D2}-\d{{4}}$",
    "d MMM yyyy": rf"^{_D2} [A-Za-z]{{3}} \d{{4}}$",
    "d/M/yyyy": rf"^{_D2}/{_D2}/\d{{4}}$",
    "M/d/yyyy H:m": rf"^{_D2}/{_D2}/\d{{4}} {_D2}:{_D2}$",
    "M/d/yyyy H:m:s": rf"^{_D2}/{_D2}/\d{{4}} {_D2}:{_D2}:{_D2}$",
    "yyyy.M.d": rf"^\d{{4}}\.{_D2}\.{_D2}$",
    "MMM d, yyyy": rf"^[A-Za-z]{{3}} {_D2}, \d{{4}}$",
    "d-MMM-yyyy": rf"^{_D2}-[A-Za-z]{{3}}-\d{{4}}$",
    "yyyy-M-d'T'H:m:s[.SSSSSS]XXX": rf"^\d{{4}}-{_D2}-{_D2}T{_D2}:{_D2}:{_D2}(\.\d{{1,6}})?(Z|[+-]\d{{2}}:\d{{2}})$",
    "yyyy-M-d H:m:s[.SSSSSS]XXX": rf"^\d{{4}}-{_D2}-{_D2} {_D2}:{_D2}:{_D2}(\.\d{{1,6}})?(Z|[+-]\d{{2}}:\d{{2}})$",
}
DATETIME_FORMATS = tuple(DATETIME_SHAPES)

TWO_POW_32 = 4294967296.0


def strip_ws(c: Column) -> Column:
    """Trim the whitespace class at both ends (``trim`` alone only removes spaces)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalize_token(c: Column, variant: bool = False) -> Column:
    """Header token: lower-case, trimmed, whitespace runs (variant: also '-' and '/') to '_',
    then only ``[a-z0-9_.]`` kept."""
    low = F.lower(strip_ws(c.cast("string")))
    sep = r"[\s\-/]+" if variant else r"\s+"
    return F.regexp_replace(F.regexp_replace(low, sep, "_"), r"[^a-z0-9_.]", "")


def null_if_token(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Trimmed text with the missing-value tokens folded to NULL."""
    t = strip_ws(c.cast("string"))
    return F.when(t.isin(*tokens), F.lit(None).cast("string")).otherwise(t)


def float_to_null(c: Column) -> Column:
    """NaN and +-Infinity become NULL (pandas treats them as missing)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def parse_number(c: Column) -> Column:
    """Text to double after removing thousands commas; anything else becomes NULL."""
    t = F.regexp_replace(strip_ws(c.cast("string")), ",", "")
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def parse_datetime(c: Column, fmt: str) -> Column:
    """Text to ``timestamp_ntz`` with one pattern; failures become NULL.  Text with a zone
    offset becomes the wall clock of UTC."""
    t = strip_ws(c.cast("string"))
    shape = DATETIME_SHAPES.get(fmt)
    parsed = F.try_to_timestamp(t, F.lit(fmt))
    if "XXX" in fmt:
        parsed = F.timestamp_add("MICROSECOND", F.unix_micros(parsed), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    parsed = parsed.cast("timestamp_ntz")
    return F.when(t.rlike(shape), parsed) if shape else parsed


def epoch_micros(c: Column, dtype, session_tz: str = "UTC") -> Column:
    """Microseconds since 1970-01-01 of a date/time column.  Wall-clock types (dates and
    ``timestamp_ntz``) are read as UTC whatever the session time zone is; ``timestamp``
    values are instants already."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def clip_round(c: Column, upper: int) -> Column:
    """Round half to even (as NumPy), clip to [0, upper], integer."""
    return F.greatest(F.lit(0), F.least(F.lit(upper), F.rint(c))).cast("int")


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def pct_error(real: Column, synth: Column) -> Column:
    """100*|r-s|/|r| (100*|r-s| when r = 0; 0 when either side is missing)."""
    d = F.abs(real - synth)
    return F.when(real.isNull() | synth.isNull(), F.lit(0.0)).otherwise(
        F.when(real == 0, d).otherwise(d / F.abs(real)) * 100.0
    )


def to_text_or_nan(c: Column) -> Column:
    """Text form of a value, missing shown as ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


# --- seeded hashing --------------------------------------------------------------------

def named(column: str) -> Column:
    """The column of exactly this name (names may hold dots)."""
    return F.col("`" + column.replace("`", "``") + "`")


def hash_u32(seed: int, stream: str | int, *cols: Column | str) -> Column:
    """Deterministic 32-bit integer from md5 of 'seed:stream:cols...' (independent of
    partitioning and of row order).  Reproducible in any SQL engine that has md5."""
    parts = [F.lit(str(seed)), F.lit(str(stream))] + [
        (named(c) if isinstance(c, str) else c).cast("string") for c in cols
    ]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, stream: str | int, *cols: Column | str) -> Column:
    """Uniform draw in (0, 1) with 52 bits of the same md5, so that a draw times the number of
    rows reaches every row of any table."""
    parts = [F.lit(str(seed)), F.lit(str(stream))] + [(named(c) if isinstance(c, str) else c).cast("string") for c in cols]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


# --- normal distribution in Column arithmetic ----------------------------------------

def normal_cdf(z: Column) -> Column:
    """Standard normal CDF (Abramowitz & Stegun 26.2.17, |error| < 7.5e-8)."""
    p, b1, b2, b3, b4, b5 = 0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429
    x = F.abs(z)
    t = 1.0 / (1.0 + p * x)
    poly = t * (b1 + t * (b2 + t * (b3 + t * (b4 + t * b5))))
    tail = F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_ppf(u: Column) -> Column:
    """Inverse standard normal CDF (Acklam's rational approximation, rel. error 1.2e-9)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    plow = 0.02425

    def tail(q: Column) -> Column:
        return (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / (
            (((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1.0
        )

    q_low = F.sqrt(-2.0 * F.log(u))
    q_high = F.sqrt(-2.0 * F.log(1.0 - u))
    q = u - 0.5
    r = q * q
    central = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / (
        ((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1.0
    )
    return (
        F.when(u < plow, tail(q_low))
        .when(u > 1.0 - plow, -tail(q_high))
        .otherwise(central)
    )


def box_muller(u1: Column, u2: Column) -> Column:
    """One standard normal draw from two independent uniforms in (0, 1)."""
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def r6(c: Column) -> Column:
    """Round to 6 decimals (result tables are compared at this precision)."""
    return F.round(c.cast("double"), 6)
