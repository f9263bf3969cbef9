"""Coverage figures and invariants of the tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_by_method(objects: DataFrame, registry: DataFrame, provenance: DataFrame) -> DataFrame:
    """attr_key, n_objects and distinct objects per way of extraction, over active objects of the registry's countries."""
    wanted = objects.where("status = 'active'").select("object_id", "country").join(registry.select("country", F.col("key").alias("attr_key")), "country")
    joined = wanted.join(provenance.select("object_id", "attr_key", "extracted_by"), ["object_id", "attr_key"], "left")
    of = lambda *ways: F.count_distinct(F.when(F.col("extracted_by").isin(*ways), F.col("object_id")))
    return joined.groupBy("attr_key").agg(
        F.count_distinct("object_id").alias("n_objects"), of("source_field").alias("source_field"), of("rule_markup").alias("rule_markup"), of("rule_text").alias("rule_text"),
        of("llm_extraction").alias("llm_extraction"), F.count_distinct(F.when(F.col("extracted_by").isNull(), F.col("object_id"))).alias("missing"))


def without_low_confidence(objects: DataFrame, provenance: DataFrame, least: float = 0.5) -> DataFrame:
    """objects with attributes of low confidence taken out of the map."""
    low = provenance.where(F.col("confidence") < least).groupBy("object_id").agg(F.collect_set("attr_key").alias("__low"))  # at most the registry's keys
    joined = objects.join(low, "object_id", "left")
    kept = F.map_filter("attributes", lambda k, _: ~F.array_contains(F.coalesce("__low", F.expr("array()").cast("array<string>")), k))
    return joined.withColumn("attributes", kept).drop("__low")


def required_coverage(objects: DataFrame, least: float = 0.5) -> DataFrame:
    """field, coverage, ok of the fields a valuation needs, over all rows."""
    share = lambda c: F.avg(c.cast("double"))
    row = objects.agg(share(F.coalesce(F.col("price_minor") > 0, F.lit(False))).alias("price"), share(F.coalesce(F.col("area_sqm") > 0, F.lit(False))).alias("area"),
                      share(F.col("zone_id").isNotNull()).alias("zone"), share(F.coalesce(F.col("property_type") != "", F.lit(False))).alias("type"))
    return row.unpivot([], ["price", "area", "zone", "type"], "field", "coverage").withColumn("ok", F.col("coverage") >= least)


def mirrors(objects: DataFrame) -> DataFrame:
    """field, only_column, only_map, differ: how columns and the attribute map disagree."""
    parts = []
    for field, kind in (("area_sqm", "decimal(10,2)"), ("rooms", "int"), ("seller_type", "string")):
        column, held = F.col(field), F.map_contains_key("attributes", field)
        value = F.try_element_at("attributes", F.lit(field)).try_cast(kind)
        parts.append(objects.agg(
            F.count_if(column.isNotNull() & ~held).alias("only_column"), F.count_if(column.isNull() & held).alias("only_map"),
            F.count_if(column.isNotNull() & held & ~value.eqNullSafe(column.cast(kind))).alias("differ")).select(F.lit(field).alias("field"), "*"))
    return reduce(DataFrame.unionByName, parts)


def invariants(objects: DataFrame, sources: DataFrame, configs: DataFrame, runs: DataFrame, notifications: DataFrame, valuations: DataFrame, as_of: dt.datetime, country: str = "CZ", not_modeled_share: float = 0.02) -> DataFrame:
    """name, status (OK, FAIL or INFO), detail of the checks on corpus, mirrors, positions, lost rows, schedule, blocks, queue and valuations."""
    corpus = objects.where((F.col("country") == country) & (F.col("status") == "active") & (F.col("property_country") == country))

    def row(df: DataFrame, name, status, detail) -> DataFrame:
        return df.select((F.lit(name) if isinstance(name, str) else name).alias("name"), (F.lit(status) if isinstance(status, str) else status).alias("status"), detail.alias("detail"))

    ok = lambda good: F.when(good, "OK").otherwise("FAIL")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    counts = objects.where(F.col("country") == country).agg(
        F.count_if(F.col("status") == "active").alias("a"), F.count_if((F.col("status") == "active") & (F.col("property_country") == country)).alias("b"), F.count_if(F.col("status") == "delisted").alias("d"))
    out = [row(counts, "corpus", "INFO", text("active=", F.col("a"), ", corpus=", F.col("b"), ", delisted=", F.col("d")))]
    gaps = mirrors(corpus)
    out.append(row(gaps, F.concat(F.lit("mirrors:"), F.col("field")), ok(F.col("only_column") + F.col("only_map") + F.col("differ") == 0), text(F.col("only_column"), "/", F.col("only_map"), "/", F.col("differ"))))
    positions = corpus.agg(F.count_if(F.col("geo_confidence").isNull()).alias("k"), F.count("*").alias("n"))
    out.append(row(positions, "not_modeled", ok((F.col("n") == 0) | (F.col("k") <= not_modeled_share * F.col("n"))), text(F.col("k"), "/", F.col("n"))))
    lost = corpus.agg(F.count_if(F.col("detail_fetched_at").isNull() & (F.col("first_seen_at") < F.lit(as_of - dt.timedelta(hours=24)))).alias("k"))
    paused = sources.agg(F.bool_and(F.col("state") == "paused")).scalar()
    out.append(row(lost, "lost", F.when(F.col("k") == 0, "OK").when(F.coalesce(paused, F.lit(False)), "INFO").otherwise("FAIL"), text(F.col("k"), " without a detail page for over 24 h")))
    active = configs.where("active").groupBy("source_id").agg(F.count("*").alias("n_configs"))
    last = runs.groupBy("source_id").agg(F.max("started_at").alias("last_at"))
    planned = sources.join(active, "source_id", "left").join(last, "source_id", "left")
    fresh = F.coalesce(F.col("n_configs") > 0, F.lit(False)) & F.coalesce(F.col("last_at") >= F.lit(as_of - dt.timedelta(hours=48)), F.lit(False))
    out.append(row(planned, F.concat(F.lit("schedule:"), F.col("source_id")), F.when(F.col("state") != "active", "INFO").otherwise(ok(fresh)), text("state=", F.col("state"), ", configs=", F.coalesce("n_configs", F.lit(0)))))
    out.append(row(sources, F.concat(F.lit("blocked:"), F.col("source_id")), ok(F.col("state") != "blocked"), text("state=", F.col("state"))))
    queue = notifications.agg(F.count_if((F.col("status") == "pending") & (F.col("created_at") < F.lit(as_of - dt.timedelta(minutes=5)))).alias("stale"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    out.append(row(queue, "notifs", ok(F.col("stale") == 0), text("pending=", F.col("pending"), ", stale=", F.col("stale"), ", failed=", F.col("failed"))))
    silent = valuations.agg(F.count("*").alias("n"), F.count_if(F.col("price_deviation").isNull() & F.col("deviation_null_reason").isNull()).alias("k"))
    out.append(row(silent, "valuations", ok(F.col("k") == 0), text(F.col("n"), " rows, ", F.col("k"), " without value and reason")))
    return reduce(DataFrame.unionByName, out)
