"""Exact money: amounts are longs in minor units, rates are decimal(20,10), no double anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 10**10


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def divide_half_away(top: Column, bottom: Column) -> Column:
    """top / bottom of whole decimals to the nearest integer, halves away from zero; bottom > 0."""
    quotient = F.call_function("div", 2 * F.abs(top) + bottom, 2 * bottom)
    return F.when(top < 0, -quotient).otherwise(quotient).cast("long")


def apply_rate(minor: Column, rate: Column, exponent_from: int = 2, exponent_to: int = 2, inverse: bool = False) -> Column:
    """minor units of one currency in minor units of another; rate is major per major, inverse divides by it. A zero rate gives null."""
    scaled = _whole(rate * F.lit(_SCALE).cast("decimal(11,0)"))
    amount = minor.cast("decimal(19,0)")
    shift = exponent_to - exponent_from
    top, bottom = (_whole(amount) * F.lit(_SCALE).cast("decimal(11,0)"), scaled) if inverse else (_whole(amount * scaled.cast("decimal(20,0)")), _whole(F.lit(_SCALE)))
    top = _whole(top * F.lit(10 ** max(shift, 0)).cast("decimal(7,0)"))
    bottom = _whole(bottom * F.lit(10 ** max(-shift, 0)).cast("decimal(7,0)"))
    return F.when(scaled > 0, divide_half_away(top, bottom))


def convert(minor: Column, currency: Column, to: str, rate_from: Column, rate_to: Column) -> Column:
    """Through EUR, rounded after each leg; rates are EUR in that currency. The same currency passes unchanged."""
    in_euro = F.when(currency == "EUR", minor).otherwise(apply_rate(minor, rate_from, inverse=True))
    out = in_euro if to == "EUR" else apply_rate(in_euro, rate_to)
    return F.when(currency == to, minor).otherwise(out)


def conversion_meta(dates: list[Column], stale: list[Column]) -> tuple[Column, Column]:
    """The older rate date, and whether any rate used is stale."""
    old = F.lit(False)
    for s in stale:
        old = old | F.coalesce(s, F.lit(False))
    return (F.least(*dates) if len(dates) > 1 else dates[0]), old


def parse_money(text: Column, exponent: int = 2) -> Column:
    """struct(minor, error) of "1 234,56" and the like: the later of '.' and ',' is the decimal separator."""
    plain = F.translate(text, "   ", "")
    unsigned = F.regexp_replace(plain, r"^[+-]", "")
    whole = F.regexp_extract(unsigned, r"^(.*?)(?:[.,]([^.,]*))?$", 1)
    part = F.regexp_extract(unsigned, r"^(.*?)(?:[.,]([^.,]*))?$", 2)
    whole = F.when(whole == "", "0").otherwise(whole)
    digits = F.concat(whole, F.rpad(part, exponent, "0")) if exponent else whole
    value = F.try_to_number(digits, F.lit("9" * (16 + exponent))).cast("long")
    error = (F.when(text.isNull() | (plain == ""), "empty").when(F.length(whole) > 15, "too_large").when(F.length(part) > exponent, "too_precise")
             .when(~whole.rlike(r"^\d+$") | ~part.rlike(r"^\d*$") | (unsigned == ""), "malformed"))
    return F.struct(F.when(error.isNull(), F.when(plain.startswith("-"), -value).otherwise(value)).alias("minor"), error.alias("error"))


def format_minor(minor: Column, exponent: int = 2) -> Column:
    """123456 -> "1234.56"."""
    size = F.lpad(F.abs(minor).cast("string"), exponent + 1, "0")
    size = F.when(F.length(F.abs(minor).cast("string")) > exponent, F.abs(minor).cast("string")).otherwise(size)
    sign = F.when(minor < 0, "-").otherwise("")
    if not exponent:
        return F.concat(sign, size)
    return F.concat(sign, F.substring(size, F.lit(1), F.length(size) - exponent), F.lit("."), F.right(size, F.lit(exponent)))


def shown_price(minor: Column, currency: Column, exponent: int = 2) -> Column:
    """450000000 -> "4 500 000 CZK": thousands apart, without a fraction of zero."""
    plain = format_minor(minor, exponent)
    number = F.regexp_replace(plain, r"\.0+$", "")
    whole, fraction = F.substring_index(number, ".", 1), F.when(number.contains("."), F.concat(F.lit("."), F.substring_index(number, ".", -1))).otherwise("")
    digits = F.reverse(F.replace(whole, F.lit("-"), F.lit("")))
    apart = F.reverse(F.array_join(F.regexp_extract_all(digits, F.lit(r"\d{1,3}"), 0), " "))
    return F.concat(F.when(number.startswith("-"), "-").otherwise(""), apart, fraction, F.lit(" "), currency)


def price_per_area(minor: Column, area: Column) -> Column:
    return F.round(minor / F.when(area > 0, area)).cast("long")
