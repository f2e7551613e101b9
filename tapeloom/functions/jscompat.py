"""Column helpers with the semantics of the JSON documents' origin: trimming, rounding, truthiness, numbers, instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming strips, a number's text form, the host of a URL.
JS_WS = r"[\t\n\x0B\f\r    -     　﻿]"
TRIMMED = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
DAY_MS = 86_400_000


def js_trim(text: Column) -> Column:
    """The text without leading and trailing Unicode white space (and byte order marks)."""
    return F.btrim(text, F.lit(TRIMMED))


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return F.coalesce(js_trim(text) == "", F.lit(True))


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), as a long."""
    return F.floor(x + 0.5)


def first_truthy(*options: Column) -> Column:
    """The first text that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in options))


def first_nonzero(*options: Column) -> Column:
    """The first number that is neither null, zero nor NaN, else null."""
    return F.coalesce(*(F.when((c != 0) & ~F.isnan(c.cast("double")), c) for c in options))


def to_number(text: Column) -> Column:
    """A text as a double: blank is 0, what is no number is null."""
    t = js_trim(text)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(NUM), t.try_cast("double"))


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, else an empty text."""
    return F.lower(F.regexp_extract(js_trim(url), HOST, 1))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, in any session zone."""
    seconds = (ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds * 1000).cast("long")


def parse_instant_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO-8601 instant; null if it does not parse."""
    return F.unix_millis(text.try_cast("timestamp"))
