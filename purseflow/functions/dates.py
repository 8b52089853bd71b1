"""Calendar arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_key(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM")


def complete_mmdd(mmdd: Column | str, sent: Column | str) -> Column:
    """Month and day of a statement with the year of the mail, or the year before if the
    month is later than the mail's. Null if there is no such day, or it is after the mail."""
    mmdd, sent = _col(mmdd), _col(sent)
    year = F.year(sent) - (F.substring(mmdd, 1, 2).try_cast("int") > F.month(sent)).cast("int")
    day = F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), mmdd), "yyyyMMdd")
    return F.when(mmdd.rlike(r"^\d{4}$") & (day <= sent), day)


def next_month(day: Column | str) -> Column:
    return F.add_months(day, 1)


def next_occurrence(first: Column | str, cursor: Column | str) -> Column:
    """The first monthly date after the cursor; days are 28 at most."""
    first, cursor = _col(first), _col(cursor)
    months = (F.year(cursor) - F.year(first)) * 12 + F.month(cursor) - F.month(first)
    ahead = months + (F.dayofmonth(cursor) >= F.dayofmonth(first)).cast("int")
    return F.when(cursor.isNull(), first).otherwise(F.add_months(first, F.greatest(F.lit(0), ahead)))


def occurrences(first: Column | str, until: Column | str) -> Column:
    first, until = _col(first), _col(until)
    return F.when(first <= until, F.sequence(first, until, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def _in_years(month: Column, day: Column, near: Column) -> Column:
    text = lambda n: F.format_string("%04d-%02d-%02d", F.year(near) + n, month, day)
    return F.array_compact(F.array(*[F.try_to_date(text(n), "yyyy-MM-dd") for n in (-1, 0, 1)]))


def nearest_date(month: Column, day: Column, near: Column) -> Column:
    """Of the dates with this month and day, that nearest to ``near``; a tie goes to the earlier."""
    ranked = F.transform(_in_years(month, day, near), lambda d: F.struct(F.abs(F.datediff(d, near)).alias("off"), d.alias("day")))
    return F.array_min(ranked)["day"]


def stem_month(stem: Column | str) -> Column:
    """The first day of the month that a sheet's name begins with (``2026-02`` or ``2026-02_...``), or null."""
    return F.try_to_date(F.concat(F.regexp_extract(_col(stem), r"^(\d{4}-\d{2})(?:_|$)", 1), F.lit("-01")), "yyyy-MM-dd")


def sheet_date(stem: Column | str, month: Column, day: Column) -> Column:
    """A row's full date from its month and day and its sheet's own month: of the years around it, the date
    nearest to the month's first day; a tie goes to the earlier. Null without a month in the name, or for a day that no such year has."""
    return nearest_date(month, day, stem_month(stem))


def nearest_day_delta(month: Column, day: Column, near: Column) -> Column:
    """Days from ``near`` to the nearest date with this month and day, signed."""
    return F.datediff(nearest_date(month, day, near), near)


def app_time(text: Column | str) -> Column:
    """An app's date and time text as struct<at string, day string, precision string>:
    ``MM-DD HH:MM`` to the minute, ``MM-DD`` to the date; null where it is neither."""
    t = F.regexp_replace(F.trim(_col(text)), r"[年月/.]", "-")
    t = F.regexp_replace(t, r"日", " ")
    part = lambda i: F.regexp_extract(t, r"(?:^|\D)(\d{1,2})-(\d{1,2})(?:\s*(\d{1,2})[:：](\d{2}))?(?:\D|$)", i)
    day = F.concat(F.lpad(part(1), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
    real = F.try_to_date(F.concat(F.lit("2000-"), day), "yyyy-MM-dd").isNotNull() & (part(1) != "")
    timed = (part(3) != "") & (part(3).try_cast("int") < 24) & (part(4).try_cast("int") < 60)
    at = F.concat(day, F.lit(" "), F.lpad(part(3), 2, "0"), F.lit(":"), part(4))
    return F.when(real, F.struct(F.when(timed, at).alias("at"), day.alias("day"), F.when(timed, F.lit("minute")).otherwise(F.lit("date")).alias("precision")))
