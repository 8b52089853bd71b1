"""Exact amounts: text to decimal, decimal to minor units, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from purseflow.functions.text import normal_space
from purseflow.schemas import MONEY


def parse_amount(text: Column | str) -> Column:
    """Statement text to an exact decimal; null if it isn't one or has more digits than fit."""
    plain = F.regexp_replace(normal_space(text), r"&yen;|[¥￥, ]", "")
    number = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain)
    fits = ~F.coalesce(F.regexp_extract(number, r"\.(\d*?)0*$", 1), F.lit("")).rlike(r"^\d{7,}$")
    return F.when(fits, number.try_cast(MONEY))


def has_minor_units(amount: Column | str) -> Column:
    """Whether an amount has two decimals at most."""
    cents = (F.col(amount) if isinstance(amount, str) else amount) * 100
    return cents == F.floor(cents)


def minor_units(amount: Column | str) -> Column:
    return ((F.col(amount) if isinstance(amount, str) else amount) * 100).cast("long")


def plain(amount: Column | str) -> Column:
    """A decimal as a plain string without trailing zeros."""
    text = (F.col(amount) if isinstance(amount, str) else amount).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def share_percent(value: Column, total: Column) -> Column:
    """Percent with one decimal, halves up; 0 where either isn't positive."""
    share = F.floor(value.cast("double") / total.cast("double") * 1000 + 0.5) / 10
    return F.when((total > 0) & (value > 0), share).otherwise(F.lit(0.0))


def app_amount(text: Column | str) -> Column:
    """Amount in a recognised text of an app: letter O for zero, several minus signs."""
    fixed = F.regexp_replace(F.translate(text, "Oo−–—﹣－，", "00-----,"), r"[\s,]", "")
    found = F.regexp_extract(fixed, r"([+-]?)[¥￥]?([+-]?\d+\.\d{2})(?!\d)", 0)
    number = F.regexp_replace(found, r"[¥￥]", "")
    return F.when(number != "", number.try_cast(MONEY))
