"""Column expressions whose semantics differ from the nearest built-in."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"


def money(c: Column | str) -> Column:
    """Money is decimal(19,4), half-up; never floating point."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def zero_money() -> Column:
    return F.lit(Decimal("0.0000")).cast(MONEY)


def month_boundaries(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end, not completed months: 31 January to 1 February is 1."""
    return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("int")


def year_boundaries(start: Column, end: Column) -> Column:
    """Calendar years apart, whatever the day: an age by this is at times a year too high."""
    return (F.year(end) - F.year(start)).cast("int")


def week_after_sunday(ts: Column) -> Column:
    """The Monday of the week; a Sunday belongs to the Monday that follows."""
    return F.date_trunc("week", ts + F.expr("interval 1 day")).cast("date")


def charindex(needle: str | None, hay: Column) -> Column:
    """1-based place of the needle, whatever the case; 0 for none and for an empty or missing needle."""
    if not needle:
        return F.lit(0)
    return F.locate(needle.lower(), F.lower(hay)).cast("int") if isinstance(hay, str) else F.instr(F.lower(hay), needle.lower()).cast("int")


def replicate(text: str, n: Column) -> Column:
    """The text n times; null for a negative n."""
    return F.when(n >= 0, F.repeat(F.lit(text), n))


def mask_email(email: Column) -> Column:
    """First character, stars up to the @, and the rest from it. Null if the @ is first or missing: the stars would be a negative number."""
    at = F.instr(email, "@")
    return F.concat(F.left(email, F.lit(1)), replicate("*", at - 2), F.substr(email, at))


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive search; % and _ in the text stay wildcards, a backslash is itself."""
    return c.ilike("%" + text.replace("\\", "\\\\") + "%")


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def week_begin(ts: Column, first_day: str = "monday") -> Column:
    """The first day of the week of a time; the week begins on the named day."""
    shift = DAYS.index(first_day)
    return F.date_add(F.date_trunc("week", ts - F.expr(f"interval {shift} days")).cast("date"), shift)


def tier(total: Column) -> Column:
    """Customer tier by revenue; Bronze without any."""
    return F.when(total >= 10000, "Platinum").when(total >= 5000, "Gold").when(total >= 1000, "Silver").otherwise("Bronze")


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """First and last name; null if either is."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def days_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later.cast("date"), earlier.cast("date"))
