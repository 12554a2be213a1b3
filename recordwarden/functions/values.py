"""Column expressions for dates, numbers and rounding."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The date and number spellings that are accepted.
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NAMED_DATE = (
    r"^(?i)(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.? (\d{1,2}),? (\d{4})"
)
HALF_DAY = r"[ T](0?[1-9]|1[0-2])(:\d{2}(?::\d{2})?) ?([AaPp])[Mm]$"
UTC_DATE = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)? ?[Zz]$"
HALF_DAY_DATE = r"^\d{4}-\d{1,2}-\d{1,2}" + HALF_DAY
OFFSET = r"(\d:\d{2}\S*?) ?(?:[Zz]|([+-])(\d{2}):?(\d{2}))$"
NUMBER_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"

def parse_date(c: Column) -> Column:
    """ISO or US-style text to a timestamp without zone; anything else to null.

    Month names, AM and PM, and offsets are understood; with an offset the time is that of UTC.
    """
    text = strip(c)
    iso = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    iso = F.when(F.contains(text, F.lit("/")), iso).otherwise(text)
    # A row pays for its own spelling only: one with a single rarity is read in generated code, and
    # the steps for any mixture of them, which are interpreted, are left to the rows that have one.
    return (
        F.when(iso.isNull() | iso.rlike(DATE_PATTERN), iso.try_cast("timestamp_ntz"))
        .when(iso.rlike(UTC_DATE), F.rtrim(iso, F.lit("Zz ")).try_cast("timestamp_ntz"))
        .when(iso.rlike(HALF_DAY_DATE), _with_full_hour(iso).try_cast("timestamp_ntz"))
        .when(iso.rlike(NAMED_DATE + "$"), _with_month_number(iso).try_cast("timestamp_ntz"))
        .otherwise(_parse_spelled_date(iso))
    )


def _parse_spelled_date(c: Column) -> Column:
    """The rarer spellings. Each step is a lambda over its input, so that generated code stays small."""
    step = lambda value, rule: F.get(F.transform(F.array(value), rule), F.lit(0))
    return step(step(step(c, _unnamed_month), _full_day), _without_offset)


def _unnamed_month(c: Column) -> Column:
    return F.when(c.rlike(NAMED_DATE), _with_month_number(c)).otherwise(c)


def _with_month_number(c: Column) -> Column:
    month = F.floor((F.instr(F.lit(MONTHS), F.lower(F.substring(c, 1, 3))) + 2) / 3)
    between = F.concat(F.lit("-"), month.cast("string"), F.lit("-"))
    return F.replace(F.regexp_replace(c, NAMED_DATE, "$3--$2"), F.lit("--"), between)


def _full_day(c: Column) -> Column:
    return F.when(c.rlike(HALF_DAY), _with_full_hour(c)).otherwise(c)


def _with_full_hour(c: Column) -> Column:
    hour = F.regexp_extract(c, HALF_DAY, 1).try_cast("int") % 12
    hour = hour + F.when(F.lower(F.regexp_extract(c, HALF_DAY, 3)) == "p", 12).otherwise(0)
    return F.concat(F.regexp_replace(c, HALF_DAY, " "), F.lpad(hour.cast("string"), 2, "0"), F.regexp_extract(c, HALF_DAY, 2))


def _without_offset(c: Column) -> Column:
    local = F.regexp_replace(c, OFFSET, "$1")
    ahead = F.regexp_extract(c, OFFSET, 3).try_cast("int") * 60 + F.regexp_extract(c, OFFSET, 4).try_cast("int")
    minutes = F.coalesce(F.when(F.regexp_extract(c, OFFSET, 2) == "-", -ahead).otherwise(ahead), F.lit(0))
    return F.when(local.rlike(DATE_PATTERN), local).try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)


def parse_number(c: Column) -> Column:
    """Plain decimal or exponent text to double; anything else to null."""
    s = strip(c)
    return F.when(s.rlike(NUMBER_PATTERN), s).try_cast("double")


def timestamp_literal(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Whole days elapsed from `start` to `end`, rounded down.

    Subtracting timestamps without zone keeps daylight saving out of the count.
    """
    elapsed = end - start
    days = F.extract(F.lit("DAY"), elapsed)
    return F.when(elapsed < F.make_dt_interval(days), days - 1).otherwise(days)


def round_exact(c: Column, digits: int) -> Column:
    """Round the stored binary value to `digits` decimals, true ties to even.

    The built-in `round` and `bround` decide on the printed decimal, so 2.675
    counts as a tie although the double lies below it. Here the error of
    `c * 10**digits` is computed exactly, and only that decides a tie.
    """
    scale = float(10 ** digits)
    product = c * scale
    split = c * 134217729.0
    high = split - (split - c)
    error = (high * scale - product) + (c - high) * scale
    nearest = F.rint(product)
    at_tie = F.abs(product - nearest) == 0.5
    whole = (
        F.when(at_tie & (error > 0), F.ceil(product).cast("double"))
        .when(at_tie & (error < 0), F.floor(product).cast("double"))
        .otherwise(nearest)
    )
    # Beyond this size neighbouring doubles are further apart than the last digit.
    return F.when(F.abs(c) < 2.0 ** 53 / scale, whole / scale).otherwise(c)
