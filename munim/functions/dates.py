"""Date texts in many layouts.

Each layout is guarded by the shape of the text, so a value is handed to one or
two formatters instead of failing its way through all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from munim.functions.amounts import null_token
from munim.functions.binding import let
from munim.functions.blank import strip
from munim.rules.patterns import CLOCK, DAY_MONTH, MONTH_WORD, TIME_OF_DAY, WEEKDAY_PREFIX
from munim.rules.tokens import MONTHS

# Accepted layouts, as (shape, Spark pattern), in order of preference.
DATE_LAYOUTS = [
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\p{L}{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\p{L}{3}/\d{4}$", "d/MMM/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}\s+\p{L}{3}\s+\d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}\s+\p{L}{3,}\s+\d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-\p{L}{3,}-\d{4}$", "d-MMMM-yyyy"),
]
# Layouts tried last (times, month first, dots).
DATE_FALLBACKS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}-\p{L}{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{1,2} \p{L}{3} \d{2}$", "d MMM yy"),
    (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$", "d-M-yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:m"),
]
# Layouts of dates and times in document tables, in order of preference.
TIMESTAMP_LAYOUTS = [
    (r"^\d{1,2} \p{L}{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d MMM yyyy H:m:s"),
    (r"^\d{1,2} \p{L}{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} [AaPp][Mm]$", "d MMM yyyy h:m:s a"),
    (r"^\d{1,2} \p{L}{3} \d{4} \d{1,2}:\d{1,2}$", "d MMM yyyy H:m"),
    (r"^\d{1,2} \p{L}{3} \d{4} \d{1,2}:\d{1,2} [AaPp][Mm]$", "d MMM yyyy h:m a"),
    (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"),
    (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}-\p{L}{3}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-MMM-yyyy H:m:s"),
    (r"^\d{1,2}-\p{L}{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-M-yyyy H:m:s"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} \p{L}{3,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-\p{L}{3,}-\d{4}$", "d-MMMM-yyyy"),
    (r"^\d{1,2} \p{L}{3} '\d{2}$", "d MMM ''yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\p{L}{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\p{L}{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\p{L}{3,} \d{1,2} \d{4}$", "MMMM d yyyy"),
]


def _century(day: Column, pattern: str) -> Column:
    """Two-digit years 69-99 belong to the 20th century."""
    if "yyyy" in pattern:
        return day
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def inferred(text: Column) -> Column:
    """struct(day, seconds) of a text whose layout is not listed, day before month; else null day.

    A time of day, a weekday in front and ordinal endings are cut off; what is left must be day,
    month and year in one of the usual orders, between any of the usual marks.  A month above 12
    changes places with the day.
    """
    clock = lambda i: F.regexp_extract(text, TIME_OF_DAY, i)
    hour = clock(1).try_cast("int")
    half = F.lower(F.left(clock(4), F.lit(1)))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    seconds = F.coalesce(hour * 3600 + clock(2).try_cast("int") * 60, F.lit(0)) + F.coalesce(
        clock(3).try_cast("int"), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(text, TIME_OF_DAY, ""), WEEKDAY_PREFIX, "")
    rest = F.regexp_replace(rest, r"(?i)(?<=\d)(?:st|nd|rd|th)\b", "")
    rest = F.btrim(F.regexp_replace(rest, r"[\s,./'\-]+|(?<=\d)T$", "-"), F.lit("-"))

    def read(t: Column) -> Column:
        part = lambda shape, i: F.regexp_extract(t, shape, i)
        number = lambda shape, i: part(shape, i).try_cast("int")

        def year(shape: str, i: int) -> Column:
            n = number(shape, i)
            return F.when(F.length(part(shape, i)) == 4, n).when(n > 68, n + 1900).otherwise(n + 2000)

        numeric = r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$"
        swapped = (number(numeric, 2) > 12) & (number(numeric, 1) <= 12)
        first, second = number(numeric, 1), number(numeric, 2)
        word = lambda shape, i: month_number(part(shape, i))
        dmy = rf"(?i)^(\d{{1,2}})-({MONTH_WORD})-(\d{{4}}|\d{{2}})$"
        mdy = rf"(?i)^({MONTH_WORD})-(\d{{1,2}})-(\d{{4}}|\d{{2}})$"
        ymd = rf"(?i)^(\d{{4}})-({MONTH_WORD})-(\d{{1,2}})$"
        iso = r"^(\d{4})-?(\d{1,2})-?(\d{1,2})$"
        day = (
            F.when(t.rlike(numeric), safe_date(
                year(numeric, 3), F.when(swapped, first).otherwise(second),
                F.when(swapped, second).otherwise(first)))
            .when(t.rlike(dmy), safe_date(year(dmy, 3), word(dmy, 2), number(dmy, 1)))
            .when(t.rlike(mdy), safe_date(year(mdy, 3), word(mdy, 1), number(mdy, 2)))
            .when(t.rlike(ymd), safe_date(year(ymd, 1), word(ymd, 2), number(ymd, 3)))
            .when(t.rlike(r"^(\d{8}|\d{4}-\d{1,2}-\d{1,2})$"), safe_date(
                number(iso, 1), number(iso, 2), number(iso, 3))))
        return F.struct(day.alias("day"), seconds.alias("seconds"))

    return let(rest, read)


def parse_date(cell: Column) -> Column:
    """Statement-cell date in any accepted layout -> DATE, else null."""
    text = F.regexp_replace(null_token(cell), "T(?=\\d)", " ")

    def read(t: Column) -> Column:
        return F.coalesce(*[
            F.when(t.rlike(shape), _century(F.try_to_date(t, pattern), pattern))
            for shape, pattern in DATE_LAYOUTS + DATE_FALLBACKS
        ], inferred(t)["day"])

    return let(text, read)


def parse_timestamp(cell: Column) -> Column:
    """Document-cell date or time -> TIMESTAMP_NTZ, else null.  A weekday prefix is dropped."""
    text = F.regexp_replace(strip(cell), r"^[A-Za-z]+,\s*", "")
    text = strip(F.regexp_replace(text, r"\s{2,}", " "))

    def stamp(t: Column, pattern: str) -> Column:
        out = F.try_to_timestamp(t, F.lit(pattern)).cast("timestamp_ntz")
        if "yyyy" in pattern:
            return out
        return F.when(F.year(out) > 2068, out - F.expr("interval 100 years")).otherwise(out)

    def read(t: Column) -> Column:
        guess = inferred(t)
        return F.coalesce(*[
            F.when(t.rlike(shape), stamp(t, pattern)) for shape, pattern in TIMESTAMP_LAYOUTS
        ], guess["day"].cast("timestamp_ntz") + F.make_interval(secs=guess["seconds"]))

    # No layout is without digits.
    return F.when(cell.rlike(r"\d"), let(text, read))


def document_day(cell: Column) -> Column:
    """Document-cell date with the time dropped."""
    return parse_timestamp(cell).cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def month_year(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_number(abbreviation: Column) -> Column:
    """``Jan``/``JANUARY`` -> 1 ... 12, else null."""
    position = F.array_position(F.lit(MONTHS), F.lower(F.left(abbreviation, F.lit(3))))
    return F.when(position > 0, position.cast("int"))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """DATE from parts; impossible dates are null."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(),
                  F.try_to_date(text, "yyyy-MM-dd"))


def day_month_time(cell: Column) -> Column:
    """``22 Mar\\n11:39 PM`` -> struct(month, day, hour, minute), null without a day and month."""
    def read(text: Column) -> Column:
        raw_hour = F.regexp_extract(text, CLOCK, 1).try_cast("int")
        half = F.upper(F.regexp_extract(text, CLOCK, 3))
        hour = (
            F.when((half == "PM") & (raw_hour != 12), raw_hour + 12)
            .when((half == "AM") & (raw_hour == 12), F.lit(0))
            .otherwise(raw_hour)
        )
        parts = F.struct(
            month_number(F.regexp_extract(text, DAY_MONTH, 2)).alias("month"),
            F.regexp_extract(text, DAY_MONTH, 1).try_cast("int").alias("day"),
            F.coalesce(hour, F.lit(0)).alias("hour"),
            F.coalesce(F.regexp_extract(text, CLOCK, 2).try_cast("int"), F.lit(0)).alias("minute"),
        )
        return F.when(text.rlike(DAY_MONTH), parts)

    return let(strip(F.regexp_replace(cell, "\n", " ")), read)


def timestamp_of(year: Column, parts: Column) -> Column:
    """Timestamp of ``day_month_time`` parts in a year; impossible values are null."""
    return F.try_make_timestamp_ntz(
        year.cast("int"), parts["month"], parts["day"], parts["hour"], parts["minute"],
        F.lit(0).cast("decimal(16,6)"),
    )
