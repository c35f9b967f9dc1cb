"""Column expressions that bring dirty ids, times and labels into one form. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_PATTERN = r"Z$|[T ].*[+-]\d{2}(:?\d{2})?$"
#: Calendar and basic spellings with what may be left out.
OTHER_SPELLINGS = ("yyyy-MM-dd[['T'][ ]HH:mm[:ss][.SSSSSSSSS]][ ][XXX][XX][X]", "yyyyMMdd['T'HHmm[ss][.SSSSSSSSS]][XXX][XX][X]")
CONTROL = "".join(map(chr, [*range(32), 127]))
#: Fixed value: the characters with Unicode's White_Space property, and the four information separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_user(c: Column | str) -> Column:
    """The id without control characters (U+0000-U+001F, U+007F); null where nothing is left."""
    return F.nullif(F.translate(_col(c), CONTROL, ""), F.lit(""))


def strip(c: Column | str) -> Column:
    """The text without surrounding white space of any kind."""
    return F.btrim(_col(c), F.lit(WHITE))


def plain(c: Column | str) -> Column:
    """Lower case without surrounding white space; null where nothing is left."""
    return F.nullif(F.lower(strip(_col(c))), F.lit(""))


def instant_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 of an ISO-8601 text or of a digit count of milliseconds; null if it denotes no instant.

    A text without an offset is UTC, whatever the session's time zone. Calendar and basic spellings, ``T`` or a blank
    before the time, and offsets as ``Z``, ``+hh``, ``+hhmm`` and ``+hh:mm`` are read.
    """
    raw = F.upper(strip(_col(c)))
    # the usual spellings take no regular expression: yyyy-MM-dd, T or a blank, HH:mm:ss, perhaps a fraction, an offset
    dated = (F.length(raw) >= 19) & (F.substring(raw, 5, 1) == "-") & F.substring(raw, 11, 1).isin("T", " ")
    zoned = F.endswith(raw, F.lit("Z")) | ((F.length(raw) > 19) & F.substring(raw, -6, 1).isin("+", "-"))
    usual = F.when(dated, F.unix_millis(F.when(zoned, raw).otherwise(F.concat(raw, F.lit("Z"))).try_cast("timestamp")))
    count = F.when(raw.rlike(r"^\d{1,18}$"), raw.try_cast("bigint"))
    return F.coalesce(usual, count, _other_ms(raw))


def _other_ms(raw: Column) -> Column:
    text = F.translate(raw, ",", ".")
    zoned = F.when(text.rlike(OFFSET_PATTERN), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(zoned, F.lit(p)) for p in OTHER_SPELLINGS]))


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 of a count of seconds or milliseconds; counts from 100 thousand million up are milliseconds."""
    n = _col(c).cast("bigint")
    return F.when(F.abs(n) >= 100_000_000_000, n).otherwise(n * 1000)
