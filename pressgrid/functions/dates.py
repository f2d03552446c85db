"""Dates: publication dates, knowledge-base times, ages, period keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_pub_date(text: Column) -> Column:
    """RFC 2822 first, else the first ten characters as an ISO date, else null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    mail = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))
    day = F.when(mail.isNotNull(), F.to_date(F.regexp_extract(bare, r"^(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy"))
    return F.coalesce(day, F.try_to_timestamp(F.substring(F.trim(text), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def parse_kb_time(text: Column) -> Column:
    """``+YYYY-MM-DDT..`` to a date; an unknown month or day, or an impossible date, gives null; the sign is ignored."""
    shape = r"^[+-]?(\d{4})-(\d{2})-(\d{2})"
    day = F.regexp_extract(text, r"^[+-]?(\d{4}-\d{2}-\d{2})", 1)
    known = text.rlike(shape) & (F.regexp_extract(text, shape, 2) != "00") & (F.regexp_extract(text, shape, 3) != "00")
    return F.when(known, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))


def age_at_death(birth: Column, death: Column) -> Column:
    """Whole years lived, one less before the birthday; negative gives null."""
    before = (F.month(death) < F.month(birth)) | ((F.month(death) == F.month(birth)) & (F.dayofmonth(death) < F.dayofmonth(birth)))
    years = F.year(death) - F.year(birth) - before.cast("int")
    return F.when(years >= 0, years)


def period_key(day: Column, granularity: str) -> Column:
    """ISO date, ``YYYY-MM``, or ISO week ``YYYY-Www``."""
    if granularity == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if granularity == "month":
        return F.date_format(day, "yyyy-MM")
    if granularity == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day))
    raise ValueError(f"no such granularity: {granularity}")
