"""Hedonic price model: ridge regression of log price per area, with zone effects shrunk towards their parents.

Spark encodes rows, sums the normal equations per fold and scores; only matrices as wide as the model reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.classes import missing_reason
from hearthline.functions.student import t_quantile
from hearthline.operators.gram import gram_sums
from hearthline.operators.ranks import folds

#: Levels of position in the order of their columns.
GEO_LEVELS = ["building", "street", "municipality", "postcode", "zone"]


@dataclass(frozen=True)
class Attribute:
    key: str
    values: tuple[str, ...] = ()  # of a one-hot attribute; without any it is a number


@dataclass(frozen=True)
class Settings:
    per_param: int = 10
    per_zone: int = 30
    folds: int = 5
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    max_condition: float = 1e12
    missing: str = "level"  # or "exclude"
    exclude_rate: float = 0.8
    widest: int = 2000  # zones and types; the normal equations are as wide as the model


@dataclass
class Fit:
    rejected: str | None = None
    n: int = 0
    names: list[str] = field(default_factory=list)
    beta: np.ndarray | None = None
    penalty: float | None = None
    cv_mse: list[float] = field(default_factory=list)
    r_squared: float | None = None
    sigma: float | None = None
    t_critical: float | None = None
    inverse: np.ndarray | None = None
    condition: float | None = None
    missing_rates: dict[str, float] = field(default_factory=dict)
    excluded: list[str] = field(default_factory=list)


def zone_groups(rows: DataFrame, parents: DataFrame, per_zone: int) -> DataFrame:
    """rows with zone_group and zone_fallback: zones of few rows take the place of their parent, or none.

    rows: zone_id among others; parents: zone_id, parent_id.
    """
    counts = rows.where("zone_id is not null").groupBy("zone_id").agg(F.count("*").alias("__n"))
    own = counts.join(parents, "zone_id", "left").select("zone_id", F.when(F.col("__n") >= per_zone, F.col("zone_id")).otherwise(F.col("parent_id")).alias("zone_group"), (F.col("__n") < per_zone).alias("zone_fallback"))
    return rows.join(own, "zone_id", "left").withColumn("zone_fallback", F.coalesce("zone_fallback", F.lit(False)))


def _is_missing(a: Attribute) -> Column:
    value = F.try_element_at("attrs", F.lit(a.key))
    return F.coalesce(~value.isin(*a.values), F.lit(True)) if a.values else value.try_cast("double").isNull()


def _layout(attributes: list[Attribute], zones: list[int], kinds: list[str], geo: bool, settings: Settings) -> list[tuple[str, Column]]:
    """Names and expressions of the model's columns, in order."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = [("intercept", F.lit(1.0))] + [(f"zone:{z}", one(F.col("zone_group") == z)) for z in zones]
    for a in attributes:
        value, missing = F.try_element_at("attrs", F.lit(a.key)), _is_missing(a)
        if not a.values:
            out += [(f"attr:{a.key}", F.coalesce(value.try_cast("double"), F.lit(0.0))), (f"attr:{a.key}:missing", one(missing))]
            continue
        out += [(f"attr:{a.key}={v}", one(value == v)) for v in a.values]
        out += [(f"attr:{a.key}=not_specified", one(missing))] if settings.missing == "level" else []
    out += [(f"type:{t}", one(F.col("property_type") == t)) for t in kinds]
    if geo:
        out += [(f"geo:{g}", one(F.col("geo_level") == g)) for g in GEO_LEVELS] + [("geo:not_specified", one(~F.coalesce(F.col("geo_level").isin(GEO_LEVELS), F.lit(False))))]
    return out + [("log_area", F.log(F.col("area_sqm").cast("double")))] + [(f"month:{m}", one(F.col("month") == m)) for m in range(2, 13)]


def zone_penalty(zones: list[int], parent: dict[int, int | None]) -> np.ndarray:
    """Zones of one parent are shrunk towards their mean (I - 11'/k), a lone one towards the intercept.

    Without any lone zone the whole block leaves one direction free that the data can't tell from the intercept; the first group's first zone then gets a unit penalty.
    """
    groups: dict[int, list[int]] = {}
    for i, z in enumerate(zones):
        up = parent.get(z)
        groups.setdefault(z if up is None else up, []).append(i)
    out = np.zeros((len(zones), len(zones)))
    for members in groups.values():
        at = np.ix_(members, members)
        out[at] = np.eye(len(members)) - (1 / len(members) if len(members) > 1 else 0)
    if zones and all(len(m) > 1 for m in groups.values()):
        first = groups[min(groups)][0]
        out[first, first] += 1
    return out


def fit(rows: DataFrame, attributes: list[Attribute], parents: DataFrame, settings: Settings = Settings()) -> tuple[Fit, DataFrame]:
    """(fit, predictions). rows: object_id, price_minor, area_sqm, zone_id, property_type, attrs map, month, geo_level.

    predictions: object_id, price_deviation, null_reason, predicted_minor, interval_low_minor, interval_high_minor, zone_fallback.
    The number of zones and attribute values is the model's width and is taken to be some hundreds.
    """
    if settings.missing not in ("level", "exclude") or settings.folds < 2 or not settings.penalties or min(settings.penalties) <= 0:
        raise ValueError("missing must be level or exclude, folds 2 or more, penalties positive")
    grouped = zone_groups(rows, parents, settings.per_zone)
    width = grouped.agg(F.count_distinct("zone_group").alias("zones"), F.count_distinct("property_type").alias("kinds")).first()
    if width["zones"] + width["kinds"] > settings.widest:
        raise ValueError(f"{width['zones']} zones and {width['kinds']} types make the model wider than {settings.widest} columns")
    seen = grouped.agg(
        F.count("*").alias("n"), F.collect_set("zone_group").alias("zones"), F.collect_set(F.nullif(F.col("property_type"), F.lit(""))).alias("kinds"),
        F.count_distinct(F.coalesce("geo_level", F.lit(""))).alias("geo"), F.avg((~F.coalesce(F.col("geo_level").isin(GEO_LEVELS), F.lit(False))).cast("double")).alias("geo_missing"),
        *[F.avg(_is_missing(a).cast("double")).alias(f"m{i}") for i, a in enumerate(attributes)]).first()
    out = Fit(n=seen["n"])
    if not out.n:
        out.rejected = "no_observations"
        return out, _rejected(grouped, out)
    out.missing_rates = {a.key: seen[f"m{i}"] for i, a in enumerate(attributes)} | {"geo_level": seen["geo_missing"]}
    out.excluded = [a.key for a in attributes if settings.missing == "exclude" and out.missing_rates[a.key] > settings.exclude_rate]
    zones, kinds = sorted(seen["zones"]), sorted(seen["kinds"])
    layout = _layout([a for a in attributes if a.key not in out.excluded], zones, kinds if len(kinds) > 1 else [], seen["geo"] > 1, settings)
    out.names, k = [name for name, _ in layout], len(layout)
    if out.n < settings.per_param * k:
        out.rejected = f"insufficient_observations: n={out.n}, params={k}, min_obs_per_param={settings.per_param}"
        return out, _rejected(grouped, out)
    encoded = folds(grouped, "object_id", min(settings.folds, out.n)).select(
        "object_id", "price_minor", "area_sqm", "zone_fallback", "fold", F.array(*[c for _, c in layout]).alias("x"), F.log(F.col("price_minor") / F.col("area_sqm").cast("double")).alias("y"))

    def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.ones(len(y)), y, np.array([len(y), y.sum(), (y * y).sum()])

    sums = gram_sums(encoded, k, least_squares, "fold")
    xx, xy, totals = (sum(s[i] for s in sums.values()) for i in range(3))
    parent = {r["zone_id"]: r["parent_id"] for r in parents.where(F.col("zone_id").isin(zones)).collect()}
    shape = np.eye(k)
    shape[0, 0] = 0
    shape[1:1 + len(zones), 1:1 + len(zones)] = zone_penalty(zones, parent)
    for penalty in settings.penalties:
        error = 0.0
        for fxx, fxy, ft in sums.values():
            b = np.linalg.solve(xx - fxx + penalty * shape, xy - fxy)
            error += ft[2] - 2 * b @ fxy + b @ fxx @ b
        out.cv_mse.append(error / out.n)
    out.penalty = settings.penalties[int(np.argmin(out.cv_mse))]
    regular = xx + out.penalty * shape
    values = np.linalg.svd(regular, compute_uv=False)
    out.condition = float(values[0] / values[-1]) if values[-1] > 0 else float("inf")
    rank = int((values > values[0] * k * np.finfo(float).eps).sum())
    if rank < k or out.condition > settings.max_condition:
        out.rejected = f"degenerate_matrix: rank={rank}/{k} cond={out.condition:.3e} (max_mat_cond={settings.max_condition:.1e})"
        return out, _rejected(grouped, out)
    out.beta, out.inverse = np.linalg.solve(regular, xy), np.linalg.inv(regular)
    sse = float(totals[2] - 2 * out.beta @ xy + out.beta @ xx @ out.beta)
    spread = float(totals[2] - totals[1] ** 2 / out.n)
    out.r_squared = 1 - sse / spread if spread > 0 else 0.0
    out.sigma, out.t_critical = float(np.sqrt(max(sse, 0.0) / max(out.n - k, 1))), t_quantile(0.975, max(out.n - k, 1))
    return out, _predictions(encoded, out)


def _predictions(encoded: DataFrame, model: Fit) -> DataFrame:
    """Scores by Arrow batches: the fit is a matrix product, and so is the interval's x'Mx; the matrix goes to each task once."""
    beta, inverse = model.beta, model.inverse

    @F.pandas_udf("fit double, spread double")
    def products(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in rows:
            x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, len(beta)))
            yield pd.DataFrame({"fit": x @ beta, "spread": ((x @ inverse) * x).sum(axis=1)})

    scored = encoded.select("object_id", "price_minor", "area_sqm", "zone_fallback", products("x").alias("p"))
    scored = scored.select("object_id", "price_minor", "area_sqm", "zone_fallback", F.col("p.fit").alias("fit"), (F.lit(model.t_critical * model.sigma) * F.sqrt(1 + F.col("p.spread"))).alias("half"))
    price = lambda e: F.exp(e) * F.col("area_sqm").cast("double")
    usable = (price(F.col("fit")) > 0) & (price(F.col("fit")) < float("inf"))
    whole = lambda e: F.when(usable, F.round(price(e)).cast("long"))
    return scored.select(
        "object_id", F.when(usable, F.col("price_minor") / price(F.col("fit")) - 1).alias("price_deviation"), F.when(~usable, "degenerate_prediction").alias("null_reason"),
        whole(F.col("fit")).alias("predicted_minor"), whole(F.col("fit") - F.col("half")).alias("interval_low_minor"), whole(F.col("fit") + F.col("half")).alias("interval_high_minor"), "zone_fallback")


def _rejected(grouped: DataFrame, model: Fit) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return grouped.select("object_id", none("double").alias("price_deviation"), F.lit(model.rejected).alias("null_reason"), none("long").alias("predicted_minor"),
                          none("long").alias("interval_low_minor"), none("long").alias("interval_high_minor"), "zone_fallback")


def valuation_run(objects: DataFrame, attributes: list[Attribute], parents: DataFrame, currency: str, settings: Settings = Settings()) -> tuple[Fit, DataFrame, DataFrame]:
    """(fit, valuations, report) of all active objects of a market.

    objects: object_id, status, price_minor, currency, area_sqm, zone_id, property_type, attrs, month, geo_level. An object that lacks something gets the first reason of the cascade
    instead of a value, the others what the model says; every row has a value or a reason. report: null_reason (null for valued ones), n.
    """
    active = objects.where("status = 'active'").withColumn("__reason", missing_reason(F.col("price_minor"), F.col("currency"), F.lit(currency), F.col("area_sqm"), F.col("zone_id"), F.col("property_type")))
    model, predicted = fit(active.where("__reason is null").drop("__reason"), attributes, parents, settings)
    lacking = active.where("__reason is not null").select("object_id", F.col("__reason").alias("null_reason"))
    valuations = predicted.unionByName(lacking, allowMissingColumns=True)
    return model, valuations, valuations.groupBy("null_reason").agg(F.count("*").alias("n"))
