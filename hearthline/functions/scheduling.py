"""Slots, windows, cooldowns and caps of a crawl schedule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_slot(ts: Column, zone: str | Column = "UTC") -> tuple[Column, Column]:
    """(day of week with Sunday 0, hour) of an instant in a time zone."""
    local = F.from_utc_timestamp(ts, zone)
    return F.dayofweek(local) - 1, F.hour(local)


def slot_key(day: Column, hour: Column) -> Column:
    return F.concat_ws("-", day.cast("string"), hour.cast("string"))


def window_hours(start: Column, end: Column) -> Column:
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.expr("array()").cast("array<int>"))


def backoff_minutes(strikes: Column, base: float = 60, multiplier: float = 2, cap: float = 72 * 60) -> Column:
    """base * multiplier^(strikes - 1), at most cap; under one strike counts as one."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(float(multiplier)), F.greatest(strikes, F.lit(1)) - 1))


def effective_cap(per_hour: Column, factor: Column) -> Column:
    return F.greatest(F.floor(per_hour * factor), F.lit(0)).cast("int")


def window_weight(average: Column, most: Column, warming: Column | bool = False, epsilon: float = 0.1) -> Column:
    """1 while warming up; else epsilon plus the rest in proportion to the best window's yield."""
    share = F.when(most > 0, epsilon + (1 - epsilon) * (average / most)).otherwise(epsilon)
    return F.when(F.lit(warming) if isinstance(warming, bool) else warming, 1.0).otherwise(share)


def delist_guard(delisted: Column, verified: Column, max_share: float, least: int) -> Column:
    """Whether taking one more row off would be too large a share of those verified; never on a small round."""
    return (verified > 0) & (verified >= least) & (100.0 * (delisted + 1) > max_share * verified)


def controls_verdict(n: Column, alive: Column) -> Column:
    return F.when(n == 0, "unverifiable").when(2 * alive >= n, "healthy").otherwise("broken")


def parse_spec(spec: str, least: int, most: int) -> list[int]:
    """"1,3-5" -> [1, 3, 4, 5]; ValueError where a part is no number or range, or lies outside least to most."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"{part!r} is no number or range")
        low, high = int(m[1]), int(m[2] or m[1])
        if low > high or low < least or high > most:
            raise ValueError(f"{part!r} isn't a range within {least}..{most}")
        found.update(range(low, high + 1))
    if not found:
        raise ValueError("the specification is empty")
    return sorted(found)
