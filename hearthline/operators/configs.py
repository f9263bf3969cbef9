"""Search configurations: checked, saved, taken out of use without being deleted; and the payloads that notifications must have."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.merging import upsert

#: What the payload of each kind of notification has to hold.
REQUIRED_KEYS = {"new_listing": ["object_id", "price", "url"], "price_drop": ["object_id", "old_price", "new_price"], "queue_depth": ["pending", "minutes"], "model_state": ["country", "deal_type", "status"]}


def config_problem(deal_type: Column, low_price: Column, high_price: Column, low_area: Column, high_area: Column, currency: Column) -> Column:
    """Why a configuration can't be saved; null if it can."""
    return (F.when(~F.coalesce(deal_type.isin("sale", "rent", "auction"), F.lit(False)), "bad_deal_type").when(low_price > high_price, "price_min_over_max").when(low_area > high_area, "area_min_over_max")
            .when((low_price < 0) | (low_area < 0), "negative_bound").when((low_price.isNotNull() | high_price.isNotNull()) & currency.isNull(), "price_without_currency"))


def saved(configs: DataFrame, changes: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(configs after the changes, rejected changes with their problem). A change has an id; it keeps created_at of the configuration that it replaces."""
    judged = changes.withColumn("problem", config_problem(*[F.col(c) for c in ("deal_type", "min_price_minor", "max_price_minor", "min_area_sqm", "max_area_sqm", "currency")]))
    good = judged.where("problem is null").drop("problem").join(configs.select("id", F.col("created_at").alias("__since")), "id", "left")
    stamped = good.withColumn("created_at", F.coalesce("__since", F.lit(now))).withColumn("updated_at", F.lit(now)).withColumn("active", F.lit(True))
    return upsert(configs, stamped.select(*configs.columns), ["id"]), judged.where("problem is not null")


def retired(configs: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """configs with those in ids (id) no longer active; rows stay, as runs refer to them. One that is retired already isn't touched."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    off = F.col("active") & F.coalesce("__gone", F.lit(False))
    new = {"active": F.col("active") & ~off, "updated_at": F.when(off, F.lit(now)).otherwise(F.col("updated_at"))}
    return configs.join(gone, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in configs.columns])


def missing_keys(kind: Column, payload: Column, required: dict[str, list[str]] | None = None) -> Column:
    """The keys that a notification's payload (map) lacks or holds as empty text; null for an unknown kind."""
    out = F.lit(None).cast("array<string>")
    for name, keys in (REQUIRED_KEYS if required is None else required).items():
        out = F.when(kind == name, F.filter(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(payload, k), F.lit("")) == "")).otherwise(out)
    return out
