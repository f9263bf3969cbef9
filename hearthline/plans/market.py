"""The test tables seen as the listing domain: orders as objects, line items as valuations, events as price history and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.sources.tables import table

#: The same views for DuckDB, to put before a query.
OBJECTS_SQL = """
    objects AS (
        SELECT o_orderkey AS id, c_nationkey::BIGINT AS zone_id, n_name AS country, CASE WHEN o_orderstatus = 'O' THEN 'sale' ELSE 'rent' END AS deal_type,
               CASE WHEN o_orderstatus = 'F' THEN 'delisted' ELSE 'active' END AS status,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE round(o_totalprice * 100)::BIGINT END AS current_price_minor, 'EUR' AS currency,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 7919 % 1900)::DOUBLE / 10::DOUBLE END AS area_sqm, (o_orderkey % 5 + 1)::INTEGER AS rooms,
               CASE o_orderkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'agency' WHEN 2 THEN 'developer' ELSE 'auction_organizer' END AS seller_type,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 12::DOUBLE + (o_orderkey * 6151 % 7000)::DOUBLE / 1000::DOUBLE END AS lng,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 48::DOUBLE + (o_orderkey * 3571 % 3000)::DOUBLE / 1000::DOUBLE END AS lat,
               c_name AS address, o_orderdate AS first_seen_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
VALUATIONS_SQL = "valuations AS (SELECT l_orderkey AS object_id, l_linenumber AS id, l_shipdate AS computed_at, (round(l_discount * 400) - 16)::DOUBLE / 100::DOUBLE AS price_deviation FROM lineitem)"
LATEST_SQL = "latest AS (SELECT DISTINCT ON (object_id) object_id, price_deviation FROM valuations ORDER BY object_id, computed_at DESC, id DESC, price_deviation DESC)"
CLASS_SQL = "CASE WHEN d IS NULL THEN 'none' WHEN d <= -0.15::DOUBLE THEN 'far_below' WHEN d < -0.05::DOUBLE THEN 'below' WHEN d <= 0.05::DOUBLE THEN 'near' WHEN d < 0.15::DOUBLE THEN 'above' ELSE 'far_above' END"
HISTORY_SQL = "history AS (SELECT user_id AS object_id, event_id AS id, ts AS change_at, round(value * 100)::BIGINT AS price_minor FROM events)"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def objects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    place = lambda base, step, most: F.when(key % 17 != 0, F.lit(float(base)) + (key * step % most).cast("double") / 1000.0)
    return rows.select(
        key.alias("id"), F.col("c_nationkey").cast("long").alias("zone_id"), F.col("n_name").alias("country"), F.when(F.col("o_orderstatus") == "O", "sale").otherwise("rent").alias("deal_type"),
        F.when(F.col("o_orderstatus") == "F", "delisted").otherwise("active").alias("status"), F.when(key % 13 != 0, cents("o_totalprice")).alias("current_price_minor"), F.lit("EUR").alias("currency"),
        F.when(key % 11 != 0, (key * 7919 % 1900).cast("double") / 10.0).alias("area_sqm"), (key % 5 + 1).cast("int").alias("rooms"),
        F.when(key % 4 == 0, "private").when(key % 4 == 1, "agency").when(key % 4 == 2, "developer").otherwise("auction_organizer").alias("seller_type"),
        place(12, 6151, 7000).alias("lng"), place(48, 3571, 3000).alias("lat"), F.col("c_name").alias("address"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"))


def valuations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").cast("timestamp").alias("computed_at"), ((F.round(F.col("l_discount") * 400) - 16) / 100.0).alias("price_deviation"))


def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("change_at"), cents("value").alias("price_minor"))
