"""Dates: status, years that are not written, and other rules. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_at(starts: Column, ends: Column, as_of: Column) -> Column:
    """upcoming, active (both ends included) or ended; unknown ends are open."""
    return F.when(starts > as_of, "upcoming").when(ends < as_of, "ended").otherwise("active")


def days_left(ends: Column, as_of: Column) -> Column:
    return F.date_diff(F.to_date(ends), F.to_date(as_of))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def release_month(text: Column, keywords: list[str] | None = None, year_word: str = "년", month_word: str = "월") -> Column:
    """First of the month that a text names in words (two to four digits of year), or else as 20yy-mm, 20yy/mm or 20yy.mm.

    With keywords, one must occur. Two-digit years are of this century. A month out of range gives null.
    """
    worded = rf"(\d{{2,4}})\s*{year_word}\s*(\d{{1,2}})\s*{month_word}"
    numeric = r"(20\d{2})\s*[/.\-]\s*(\d{1,2})"
    part = lambda i: F.when(text.rlike(worded), F.regexp_extract(text, worded, i)).otherwise(F.regexp_extract(text, numeric, i)).try_cast("int")
    year = F.when(part(1) < 100, part(1) + 2000).otherwise(part(1))
    asked = F.lit(True) if keywords is None else text.rlike("|".join(keywords))
    return F.when(asked & part(2).between(1, 12), F.make_date(year, part(2), F.lit(1)))


def year_of_event(posted: Column, month: Column, day: Column) -> Column:
    """The post's year, or the next where that day would lie before the post."""
    here = safe_date(F.year(posted), month, day)
    return F.when(here < F.to_date(posted), safe_date(F.year(posted) + 1, month, day)).otherwise(here)


def year_by_half(posted: Column, month: Column, day: Column, months_back: int = 6) -> Column:
    """The post's year, or the next where the month lies more than ``months_back`` before the post's."""
    year = F.year(posted) + F.when(month < F.month(posted) - months_back, 1).otherwise(0)
    return safe_date(year, month, day)


def ticket_date(event_date: Column, month: Column, day: Column) -> Column:
    """Ticket sales open in the event's year, or the year before where that lies after the event."""
    here = safe_date(F.year(event_date), month, day)
    return F.when(here > event_date, safe_date(F.year(event_date) - 1, month, day)).otherwise(here)


def range_end(starts: Column, ends: Column) -> Column:
    """An end before its start is of the next year."""
    return F.when(ends < starts, F.add_months(ends, 12)).otherwise(ends)


def first_format(text: Column, formats: list[str]) -> Column:
    """A timestamp by the first format that reads."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def month_window(year: int, month: int) -> tuple[Column, Column]:
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return first, F.last_day(first)


def week_start(day: Column) -> Column:
    """Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def release_date(text: Column) -> Column:
    """An ISO date, or an English month with an optional day ("Aug 2025", "14 August 2025"); the day is 1 where none is given."""
    iso = F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    found = lambda i: F.regexp_extract(F.lower(text), r"(?:(\d{1,2})\s+)?\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{4})", i)
    month = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), found(2)) - 1) / 3) + 1
    named = F.when(found(3) != "", safe_date(found(3).try_cast("int"), month.cast("int"), F.coalesce(found(1).try_cast("int"), F.lit(1))))
    return F.coalesce(iso, named)


def last_moment(day: Column) -> Column:
    """23:59:59 of a day."""
    return F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 23:59:59")))


def expiry_by_post(posted: Column, month: Column, day: Column) -> Column:
    """The end of a day whose year isn't written: the next year where its month lies more than one before the post's."""
    return last_moment(year_by_half(posted, month, day, 1))


def announced_expiry(title: Column, body: Column, posted: Column, month_word: str = "월", day_word: str = "일") -> Column:
    """The end of the day after a title's "~", or else of the last day that the body names; no year is written.

    The year is the post's, or the next where the month lies more than one before the post's. A day past its month's
    end runs into the next month; null where no day of 1 to 31 in a month of 1 to 12 is named.
    """
    day = rf"(\d{{1,2}})\s*{month_word}\s*(\d{{1,2}})\s*{day_word}"
    named = lambda i: F.coalesce(F.nullif(F.regexp_extract(title, rf"~\s*{day}", i), F.lit("")), F.try_element_at(F.regexp_extract_all(body, F.lit(day), i), F.lit(-1)))
    month, nth = named(1).try_cast("int"), named(2).try_cast("int")
    year = F.year(posted) + F.when(month < F.month(posted) - 1, 1).otherwise(0)
    first = F.when(month.between(1, 12) & nth.between(1, 31), F.make_date(year, month, F.lit(1)))
    return last_moment(F.date_add(first, nth - 1))


def mentioned_dates(text: Column) -> Column:
    """Distinct real dates in yyyy-mm-dd, yyyy.mm.dd or yyyy/mm/dd form, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d\d[-./]\d{1,2}[-./]\d{1,2})(?!\d)"), 1)
    parts = F.transform(found, lambda s: F.transform(F.split(s, "[-./]"), lambda p: p.try_cast("int")))
    days = F.transform(parts, lambda p: safe_date(p[0], p[1], p[2]))
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull())))


def trusted_announcement(announced: Column, listed: Column) -> Column:
    """Null where an announced moment is of the year 9999 or on a day that is merely one of the listing's."""
    return F.when((F.year(announced) == 9999) | F.coalesce(F.array_contains(listed, F.to_date(announced)), F.lit(False)), None).otherwise(announced)


def time_known(announced: Column) -> Column:
    """Noon sharp stands for an unknown time."""
    return ~((F.hour(announced) == 12) & (F.minute(announced) == 0))


def local_time(utc: Column, zone: str = "Asia/Seoul") -> Column:
    """A UTC moment (without zone) as the clock of a zone shows it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def human_date(moment: Column) -> Column:
    """Such as "Aug 14 (Thu) 8:00 PM"."""
    return F.date_format(moment, "MMM d (EEE) h:mm a")


def post_expiry(text: Column, posted: Column, year_word: str = "년", month_word: str = "월", day_word: str = "일", until: str = "까지", label: str = "유효\\s*기간|기한") -> Column:
    """The expiry that a post names: with a year after a label or before "until", else without one in the post's year.

    The time is 23:59 where none is given; an impossible date gives null.
    """
    clock = r"(?:\s*(\d{1,2})\s*:\s*(\d{2}))?"
    day = rf"(\d{{1,2}})\s*{month_word}\s*(\d{{1,2}})\s*{day_word}{clock}"
    labelled, dated, short = rf"(?:{label})[^0-9]{{0,8}}(\d{{4}})\s*{year_word}\s*{day}", rf"(\d{{4}})\s*{year_word}\s*{day}\s*{until}", rf"{day}\s*{until}"
    part = lambda i: F.when(text.rlike(labelled), F.regexp_extract(text, labelled, i)).when(text.rlike(dated), F.regexp_extract(text, dated, i)).when(
        text.rlike(short), F.regexp_extract(text, short, i - 1) if i > 1 else F.year(posted).cast("string")
    )
    given = lambda i, other: F.coalesce(F.nullif(part(i), F.lit("")), F.lit(other)).try_cast("int")
    on = safe_date(part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"))
    at = F.concat(on.cast("string"), F.lit(" "), F.lpad(given(4, "23").cast("string"), 2, "0"), F.lit(":"), F.lpad(given(5, "59").cast("string"), 2, "0"), F.lit(":00"))
    return F.try_to_timestamp(at)


def scope_at(starts: Column, as_of: Column) -> Column:
    """current once begun, else forecast."""
    return F.when(starts <= as_of, "current").otherwise("forecast")


def ticket_opening(text: Column, event_date: Column, general: str) -> Column:
    """The first month/day after the general sale's word, or else the first of the text, in the year of ticket_date."""
    day = r"(\d{1,2})/(\d{1,2})"
    after = rf"{general}\D*{day}"
    part = lambda i: F.when(text.rlike(after), F.regexp_extract(text, after, i)).otherwise(F.regexp_extract(text, day, i)).try_cast("int")
    return ticket_date(event_date, part(1), part(2))
