"""Date and time functions; 'now' and 'today' are always parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month numbers by English names, short and full, and by Thai abbreviations, formal and common.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3,
    "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
    "ม.ค.": 1, "มค.": 1, "มค": 1,
    "ก.พ.": 2, "กพ.": 2, "กพ": 2,
    "มี.ค.": 3, "มีค.": 3, "มีค": 3,
    "เม.ย.": 4, "เมย.": 4, "เมย": 4,
    "พ.ค.": 5, "พค.": 5, "พค": 5,
    "มิ.ย.": 6, "มิย.": 6, "มิย": 6,
    "ก.ค.": 7, "กค.": 7, "กค": 7,
    "ส.ค.": 8, "สค.": 8, "สค": 8,
    "ก.ย.": 9, "กย.": 9, "กย": 9,
    "ต.ค.": 10, "ตค.": 10, "ตค": 10,
    "พ.ย.": 11, "พย.": 11, "พย": 11,
    "ธ.ค.": 12, "ธค.": 12, "ธค": 12,
}


def iso_millis(ms: Column) -> Column:
    """ISO 8601 in UTC of epoch milliseconds; the session's time zone is UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_of(ms: Column, zone: str = "UTC") -> Column:
    """'YYYY-MM-DD' of epoch milliseconds in a time zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd")


def age_hours(now_ms: int, ms: Column) -> Column:
    """Hours since ``ms``, to one decimal."""
    return F.round((F.lit(now_ms) - ms) / 3_600_000.0, 1)


def month_of(name: Column) -> Column:
    """Number of a month's English or Thai name, null for any other word."""
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def parsed_date(c: Column, today: str) -> Column:
    """'YYYY-MM-DD' of a date as people write it, else ``today``.

    ISO; today, tomorrow; day month [year] and month day[,] [year] in English or Thai; day/month[/year] or
    with hyphens.  Two-digit years are of this century, a missing year is that of ``today``.  Months over 12 and days
    over 31 are no dates; a day that its month lacks is kept as written.  Null stays null.
    """
    t = F.trim(c)
    dmy = r"^(\d{1,2})\s+([A-Za-zก-๙.]+)(?:\s+(\d{4}))?$"
    mdy = r"^([A-Za-zก-๙.]+)\s+(\d{1,2})(?:[,\s]+(\d{4}))?$"
    num = r"^(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?$"
    # at most one of the patterns matches, so each part is taken from whichever does
    part = lambda *places: F.coalesce(*(F.nullif(F.regexp_extract(t, pattern, at), F.lit("")) for pattern, at in places))
    day, written = part((dmy, 1), (mdy, 2), (num, 1)).cast("int"), part((dmy, 3), (mdy, 3), (num, 3))
    month = F.coalesce(month_of(part((dmy, 2), (mdy, 1))), part((num, 2)).cast("int"))
    year = F.when(F.length(written) == 2, F.concat(F.lit("20"), written)).otherwise(F.coalesce(F.regexp_replace(written, "^0+(?=.)", ""), F.lit(today[:4])))
    made = F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(F.lower(t) == "tomorrow", F.date_format(F.date_add(F.lit(today).cast("date"), 1), "yyyy-MM-dd"))
        .when(t.isNotNull(), F.coalesce(made, F.lit(today)))
    )


def file_timestamp(name: Column) -> Column:
    """ISO time of a file name that starts with 'YYYY-MM-DD_HH-MM', else null."""
    p = r"^(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})"
    found = F.concat(F.regexp_extract(name, p, 1), F.lit("T"), F.regexp_extract(name, p, 2), F.lit(":"), F.regexp_extract(name, p, 3), F.lit(":00"))
    return F.when(name.rlike(p), found)
