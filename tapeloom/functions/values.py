"""Field values: padding, numbers, exchange time, dates and prices.

Column functions take the raw text of a cell, already cut from its record.  A
cell that is all padding is blank; one that is neither blank nor valid is bad.
Values are null for both; decoding tells them apart with ``is_blank``.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feeds.
TICKS_PER_SECOND = 65_536
EPOCH_1980_MICROS = 315_532_800_000_000
PAD_CHARACTERS = "b "
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

_UNIX_START = "timestamp_ntz'1970-01-01 00:00:00'"
_TIME = re.compile(r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?")


def unpad(raw: Column, side: str | None) -> Column:
    """Strip ``b`` and blanks from the padded side only; anything else is data."""
    if side is None:
        return raw
    trim = {"left": F.ltrim, "right": F.rtrim, "both": F.trim}[side]
    return trim(raw, F.lit(PAD_CHARACTERS))


def is_blank(raw: Column) -> Column:
    return F.trim(raw, F.lit(PAD_CHARACTERS)) == ""


def digits_value(text: Column) -> Column:
    """The value of text without left padding, or null if it is not digits alone (of at most 18).

    Casting refuses anything inside a number; comparing the first and last character refuses the
    signs and blanks it would allow around one.
    """
    is_digit = lambda c: (c >= "0") & (c < ":")
    return F.when(is_digit(text) & is_digit(F.substring(text, -1, 1)), text.try_cast("bigint"))


def whole_number(raw: Column) -> Column:
    """A number, or null where the cell is blank or holds anything but digits after its padding."""
    return digits_value(unpad(raw, "left"))


def small_number(raw: Column) -> Column:
    """A number of at most 255."""
    n = whole_number(raw)
    return F.when(n <= 255, n.cast("smallint"))


def micros_of_ticks(ticks: Column) -> Column:
    """Exchange clock (1/65536 s since 1980) to microseconds since 1970, cut to whole ones."""
    part = ticks.bitwiseAND(F.lit(TICKS_PER_SECOND - 1)) * F.lit(1_000_000)
    return F.shiftright(ticks, 16) * F.lit(1_000_000) + F.shiftright(part, 16) + F.lit(EPOCH_1980_MICROS)


def timestamp_of_micros(micros: Column) -> Column:
    """Wall-clock timestamp without a zone, whatever zone the session has."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(_UNIX_START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def micros_of_timestamp(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_UNIX_START), ts)


def time_of_day(ts: Column) -> Column:
    """Whole seconds since midnight."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_of_hms(raw: Column) -> Column:
    """HH:MM:SS to seconds since midnight."""
    part = lambda at: F.substring(raw, at, 2).try_cast("int")
    return F.when(raw.rlike(r"\A([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"), part(1) * 3600 + part(4) * 60 + part(7))


def _made_date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def date_of_dmmmy(raw: Column) -> Column:
    """ddMMMyyyy; the month in any case, the day may be padded."""
    month = F.lit(None).cast("int")
    name = F.upper(F.substring(raw, 3, 3))
    for i, m in enumerate(MONTHS):
        month = F.when(name == m, i + 1).otherwise(month)
    day = unpad(F.substring(raw, 1, 2), "left")
    ok = raw.rlike(r"\A[b 0-9][0-9][A-Za-z]{3}[0-9]{4}\z")
    return F.when(ok & month.isNotNull(), _made_date(F.substring(raw, 6, 4), month, day))


def date_of_ymd(raw: Column) -> Column:
    """YYYYMMDD."""
    ok = raw.rlike(r"\A[0-9]{8}\z")
    return F.when(ok, _made_date(F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)))


def flag_of_yn(raw: Column) -> Column:
    return F.when(raw == "Y", True).when(raw == "N", False)


def scaled_price(price: Column, scale: int) -> Column:
    """A raw integer price in currency units, for display; compare raw prices instead."""
    return price / F.lit(10**scale)


def ticks_of(day: date, text: str) -> int:
    """Exchange clock of ``HH:MM:SS[.fraction]`` on a day; fractions are cut to whole ticks."""
    m = _TIME.fullmatch(text.strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3]) > 59:
        raise ValueError(f"{text!r} is not a time of the form HH:MM:SS[.fraction]")
    seconds = (day - date(1980, 1, 1)).days * 86_400 + int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])
    fraction = m[4] or ""
    part = int(fraction) * TICKS_PER_SECOND // 10 ** len(fraction) if fraction else 0
    return seconds * TICKS_PER_SECOND + part


def datetime_of_ticks(ticks: int) -> datetime:
    micros = (ticks >> 16) * 1_000_000 + ((ticks & 0xFFFF) * 1_000_000 >> 16)
    return datetime(1980, 1, 1) + timedelta(microseconds=micros)


def human_bytes(n: float) -> str:
    """A size with a binary unit."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    k = 0
    while n >= 1024 and k + 1 < len(units):
        n, k = n / 1024, k + 1
    return f"{n:.0f} {units[k]}" if k == 0 else f"{n:.1f} {units[k]}"


def throughput(rows: int, seconds: float) -> str:
    """Rows a second in words."""
    return f"{rows / seconds / 1e6:.2f} M rows/s" if seconds > 0 else "-"
