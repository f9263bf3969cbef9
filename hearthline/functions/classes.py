"""Classes and reasons that several queries share: deviation classes, why a row has no value, registry-typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of a price's deviation from the model, with their bounds.
DEVIATION_CLASSES = ["far_below", "below", "near", "above", "far_above", "none"]


def deviation_class(d: Column) -> Column:
    return F.when(d.isNull(), "none").when(d <= -0.15, "far_below").when(d < -0.05, "below").when(d <= 0.05, "near").when(d < 0.15, "above").otherwise("far_above")


def missing_reason(price: Column, currency: Column, market_currency: Column, area: Column, zone: Column, kind: Column) -> Column:
    """Why a row can't be valued, the first that holds; null if it can."""
    return (F.when(price.isNull() | (price <= 0), "no_price").when(currency.isNull(), "no_currency").when(currency != market_currency, "currency_mismatch")
            .when(area.isNull() | (area <= 0), "no_area").when(zone.isNull(), "no_zone").when(kind.isNull() | (kind == ""), "no_type"))


def usable_area(column: Column, attributes: Column) -> Column:
    """The area column if positive, else the positive area among the attributes."""
    other = F.try_element_at(attributes, F.lit("area_sqm")).try_cast("double")
    return F.coalesce(F.when(column > 0, column), F.when(other > 0, other))


def geometry_kind(lat: Column, lng: Column, zone: Column) -> Column:
    return F.when(lat.isNotNull() & lng.isNotNull(), "point").when(zone.isNotNull(), "area").otherwise("none")


def valid_value(value: Column, data_type: Column, allowed: Column, low: Column, high: Column) -> Column:
    """Null if a text value fits a registry entry's type, list and range, else why not."""
    number = value.try_cast("double")
    ranged = F.when((number < low) | (number > high), "out_of_range")
    return (F.when(value.isNull(), "missing")
            .when(data_type == "bool", F.when(~F.lower(value).isin("true", "false"), "not_bool"))
            .when(data_type == "enum", F.when(allowed.isNull(), "enum_without_values").when(~F.array_contains(F.transform(allowed, F.lower), F.lower(value)), "not_allowed"))
            .when(data_type == "int", F.when(number.isNull() | (number != F.floor(number)), "not_int").otherwise(ranged))
            .when(data_type == "float", F.when(number.isNull(), "not_number").otherwise(ranged)).otherwise("unknown_type"))
