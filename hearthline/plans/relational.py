"""Queries of joins, aggregates and set operations (inventory B, C, D, E, G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions.classes import deviation_class
from hearthline.operators import catalog, latest, merging, queues
from hearthline.plans import market
from hearthline.plans.registry import query
from hearthline.sources.tables import TABLES, table

t = table


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT AS price_minor, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def d02_latest_order(spark: SparkSession, d: str) -> DataFrame:
    rows = latest.latest_per_key(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", market.cents("o_totalprice").alias("price_minor"), "o_orderstatus")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k <= 3")
def g03_top_per_group(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return latest.top_per_key(t(spark, d, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"""WITH {market.HISTORY_SQL}, points AS (SELECT object_id, first(price_minor ORDER BY change_at, id) AS first_value, last(price_minor ORDER BY change_at, id) AS last_value, count(*) AS n_points FROM history GROUP BY object_id)
    SELECT *, CASE WHEN n_points >= 2 AND last_value < first_value THEN 'reduced' WHEN n_points >= 2 AND last_value > first_value THEN 'increased' END AS trend FROM points""")
def d04_first_last_trend(spark: SparkSession, d: str) -> DataFrame:
    points = latest.first_last(market.history(spark, d), ["object_id"], "change_at", "id", "price_minor")
    return points.withColumn("trend", latest.trend("first_value", "last_value", "n_points"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def d01_join_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def d09_semi_exists(spark: SparkSession, d: str) -> DataFrame:
    pending = t(spark, d, "orders").where("o_orderstatus = 'P'")
    return t(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def d10_anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    returned = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    return t(spark, d, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_name, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'F') AS last_shipped FROM supplier")
def d22_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    last = t(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_shipped"))
    return t(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", "last_shipped")


@query("""SELECT n_name, p_brand, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price_minor, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def d19_chained_joins(spark: SparkSession, d: str) -> DataFrame:
    chain = (t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left"))
    return chain.groupBy("n_name", "p_brand").agg(F.sum(market.cents("l_extendedprice")).alias("price_minor"), F.count("*").alias("n"))


_WINDOWS_SQL = "SELECT s_nationkey % 4 AS source_id, s_suppkey AS window_id, (s_suppkey % 7)::INTEGER AS day, (s_suppkey * 5 % 20)::INTEGER AS lo, (s_suppkey * 5 % 20 + 1 + s_suppkey % 4)::INTEGER AS hi, (s_suppkey % 9)::INTEGER AS weight, (s_suppkey % 11 + 1)::INTEGER AS cap FROM supplier"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as crawl windows of four sources."""
    k = F.col("s_suppkey")
    low = (k * 5 % 20).cast("int")
    return t(spark, d, "supplier").select((F.col("s_nationkey") % 4).alias("source_id"), k.alias("window_id"), (k % 7).cast("int").alias("day_of_week"), low.alias("hour_start"), (low + 1 + k % 4).cast("int").alias("hour_end"), (k % 9).cast("int").alias("weight"), (k % 11 + 1).cast("int").alias("cap"))


@query(f"WITH w AS ({_WINDOWS_SQL}) SELECT event_id, max(weight)::INTEGER AS weight, min(cap)::INTEGER AS cap FROM events JOIN w ON user_id % 4 = source_id AND extract(dow FROM ts) = day AND extract(hour FROM ts) >= lo AND extract(hour FROM ts) < hi GROUP BY event_id")
def d26_window_match(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.operators.scheduling import matching_windows

    moments = t(spark, d, "events").select("event_id", (F.col("user_id") % 4).cast("int").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    return matching_windows(moments, _windows(spark, d), "ts").select("event_id", "weight", "cap")


@query(f"WITH w AS ({_WINDOWS_SQL}) SELECT a.window_id AS a, b.window_id AS b FROM w a JOIN w b ON a.source_id = b.source_id AND a.day = b.day AND a.window_id < b.window_id AND a.lo < b.hi AND b.lo < a.hi")
def d27_overlaps(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.operators.scheduling import overlapping_windows

    return overlapping_windows(_windows(spark, d)).select("a", "b")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS reuse_id FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1 AND doc_id <> min(doc_id) OVER (PARTITION BY sha256(text))")
def d24_hash_reuse(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("reuse_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id <> reuse_id").select("doc_id", "reuse_id")


@query("SELECT o_orderkey, coalesce(s, o_custkey) AS matched FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) ON l_orderkey = o_orderkey")
def d07_first_known(spark: SparkSession, d: str) -> DataFrame:
    found = t(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    return t(spark, d, "orders").join(found, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("s", "o_custkey").alias("matched"))


@query("""WITH last AS (SELECT user_id, max(ts) AS last_at FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT c_custkey % 2 AS side, c_custkey FROM customer LEFT JOIN last ON user_id = c_custkey
    QUALIFY row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY last_at ASC NULLS FIRST, c_custkey) = 1""")
def d23_round_robin(spark: SparkSession, d: str) -> DataFrame:
    last = t(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    rows = t(spark, d, "customer").join(last, F.col("user_id") == F.col("c_custkey"), "left").withColumn("side", F.col("c_custkey") % 2)
    return latest.top_per_key(rows, ["side"], [F.col("at").asc_nulls_first(), F.asc("c_custkey")]).select("side", "c_custkey")


@query("SELECT c_mktsegment AS segment, n_nationkey AS nation, count(c_custkey) AS n, count(o.o_custkey) AS with_orders FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c USING (c_mktsegment) LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c_custkey WHERE c_nationkey = n_nationkey GROUP BY ALL")
def d20_registry_fanout(spark: SparkSession, d: str) -> DataFrame:
    buyers = t(spark, d, "orders").select("o_custkey").distinct()
    rows = t(spark, d, "nation").join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").alias("nation")).agg(F.count("c_custkey").alias("n"), F.count("o_custkey").alias("with_orders"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) FILTER (WHERE o_totalprice > 250000) AS n_large, count(*) AS n FROM orders GROUP BY 1")
def e02_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(status == "O").alias("n_open"), F.count_if(status == "F").alias("n_done"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"), F.count("*").alias("n"))


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL} SELECT country, deal_type, count(*) AS n, count(price_deviation) AS n_valued, max(price_deviation) AS best FROM objects LEFT JOIN latest ON id = object_id GROUP BY ALL""")
def e04_market_pairs(spark: SparkSession, d: str) -> DataFrame:
    last = latest.top_per_key(market.valuations(spark, d), ["object_id"], [F.desc("computed_at"), F.desc("id"), F.desc("price_deviation")]).drop("id")
    return market.objects(spark, d).join(last, F.col("id") == F.col("object_id"), "left").groupBy("country", "deal_type").agg(F.count("*").alias("n"), F.count("price_deviation").alias("n_valued"), F.max("price_deviation").alias("best"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def e05_dominant_reason(spark: SparkSession, d: str) -> DataFrame:
    return latest.dominant(t(spark, d, "events"), ["user_id"], "event_type")


@query(f"""WITH {market.OBJECTS_SQL}, {market.HISTORY_SQL}, active AS (SELECT * FROM objects WHERE status = 'active'),
    moves AS (SELECT object_id, p[1] AS p0, p[2] AS p1 FROM (SELECT object_id, list(price_minor ORDER BY change_at DESC, id DESC) AS p FROM history GROUP BY object_id) WHERE len(p) >= 2),
    trends AS (SELECT zone_id, count(*) AS n_history, count(*) FILTER (WHERE p0 < p1) AS n_down FROM active JOIN moves ON id = object_id GROUP BY zone_id)
    SELECT a.zone_id, count(*) AS n, round_even(quantile_cont(current_price_minor, 0.5), 0)::BIGINT AS median_minor, round(sum(current_price_minor)::DOUBLE / count(*))::BIGINT AS mean_minor,
        round((sum(current_price_minor) FILTER (WHERE area_sqm > 0))::DOUBLE / sum(area_sqm) FILTER (WHERE area_sqm > 0))::BIGINT AS per_area_minor, min(currency) AS currency,
        coalesce(any_value(n_history), 0) AS n_history, coalesce(any_value(n_down), 0) AS n_down,
        round(CASE WHEN coalesce(any_value(n_history), 0) >= 5 THEN any_value(n_down)::DOUBLE / any_value(n_history) END, 6) AS down_share, CASE WHEN coalesce(any_value(n_history), 0) < 5 THEN 'insufficient_history' END AS trend_reason
    FROM active a LEFT JOIN trends t ON a.zone_id = t.zone_id GROUP BY a.zone_id""")
def e06_zone_cards(spark: SparkSession, d: str) -> DataFrame:
    return catalog.zone_cards(market.objects(spark, d), market.history(spark, d), 5).withColumn("down_share", F.round("down_share", 6))


@query("""SELECT l_shipmode_class AS kind, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS accepted,
    count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS still_open, count(DISTINCT CASE WHEN l_discount = 0 THEN l_orderkey END) AS full_price FROM (SELECT *, l_suppkey % 3 AS l_shipmode_class FROM lineitem) GROUP BY 1""")
def e09_distinct_by_way(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.count_distinct(F.when(c, F.col("l_orderkey")))
    return t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("kind")).agg(
        F.count_distinct("l_orderkey").alias("n_orders"), of(F.col("l_returnflag") == "R").alias("returned"), of(F.col("l_returnflag") == "A").alias("accepted"), of(F.col("l_linestatus") == "O").alias("still_open"), of(F.col("l_discount") == 0).alias("full_price"))


@query("SELECT c_custkey, strftime(least(min(o_orderdate), min(l_shipdate)), '%Y-%m-%d') AS first_seen FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def e11_earliest(spark: SparkSession, d: str) -> DataFrame:
    shipped = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    rows = t(spark, d, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.least(F.min("o_orderdate"), F.min("shipped")), "yyyy-MM-dd").alias("first_seen"))
    return rows.join(t(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(round(value * 100)::BIGINT)::BIGINT AS total_minor, strftime(max(ts), '%Y-%m-%d') AS last_day, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events GROUP BY 1")
def e03_group_counts(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(market.cents("value")).alias("total_minor"), day(F.max("ts")).alias("last_day"), day(F.min("ts")).alias("first_day"))


@query("SELECT o_custkey, coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (WHERE o_orderstatus = 'P'), 0)::BIGINT AS spent FROM orders GROUP BY 1")
def e13_sum_or_zero(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", market.cents("o_totalprice"))), F.lit(0)).alias("spent"))


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL}, classed AS (SELECT round_even(lng / 0.3515625, 0)::BIGINT AS cell_x, round_even(lat / 0.3515625, 0)::BIGINT AS cell_y, {market.CLASS_SQL} AS dev_class
        FROM (SELECT *, price_deviation AS d FROM objects LEFT JOIN latest ON id = object_id) WHERE lng IS NOT NULL),
    counted AS (SELECT cell_x, cell_y, dev_class, count(*) AS c FROM classed GROUP BY ALL), led AS (SELECT *, max(c) OVER (PARTITION BY cell_x, cell_y) AS lead FROM counted)
    SELECT cell_x, cell_y, sum(c)::BIGINT AS n, CASE WHEN count(*) FILTER (WHERE c = lead) = 1 THEN min(dev_class) FILTER (WHERE c = lead) END AS dev_class, count(*) FILTER (WHERE c = lead) > 1 AS mixed FROM led GROUP BY ALL""")
def e15_map_cells(spark: SparkSession, d: str) -> DataFrame:
    last = latest.top_per_key(market.valuations(spark, d), ["object_id"], [F.desc("computed_at"), F.desc("id"), F.desc("price_deviation")]).drop("id")
    rows = market.objects(spark, d).where("lng is not null").join(last, F.col("id") == F.col("object_id"), "left").withColumn("dev_class", deviation_class(F.col("price_deviation")))
    return catalog.map_cells(rows, "lng", "lat", 0.3515625)


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL}, counted AS (SELECT zone_id, {market.CLASS_SQL} AS dev_class, count(*) AS c FROM (SELECT *, price_deviation AS d FROM objects LEFT JOIN latest ON id = object_id) WHERE lat IS NULL GROUP BY ALL),
    led AS (SELECT *, max(c) OVER (PARTITION BY zone_id) AS lead FROM counted)
    SELECT zone_id, sum(c)::BIGINT AS n, CASE WHEN count(*) FILTER (WHERE c = lead) = 1 THEN min(dev_class) FILTER (WHERE c = lead) END AS dev_class, count(*) FILTER (WHERE c = lead) > 1 AS mixed FROM led GROUP BY ALL""")
def e17_map_areas(spark: SparkSession, d: str) -> DataFrame:
    last = latest.top_per_key(market.valuations(spark, d), ["object_id"], [F.desc("computed_at"), F.desc("id"), F.desc("price_deviation")]).drop("id")
    return catalog.map_areas(market.objects(spark, d).join(last, F.col("id") == F.col("object_id"), "left"))


@query(f"WITH {market.OBJECTS_SQL} SELECT round(avg((coalesce(current_price_minor, 0) > 0)::INTEGER), 6) AS price, round(avg((coalesce(area_sqm, 0) > 0)::INTEGER), 6) AS area, round(avg((zone_id IS NOT NULL)::INTEGER), 6) AS zone FROM objects")
def e18_required_coverage(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.operators.quality import required_coverage

    rows = required_coverage(market.objects(spark, d).select(F.col("current_price_minor").alias("price_minor"), "area_sqm", "zone_id", F.lit("flat").alias("property_type")))
    return rows.groupBy().pivot("field", ["price", "area", "zone"]).agg(F.round(F.first("coverage"), 6))


@query("SELECT name, n FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders)")
def e29_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return merging.table_counts({name: t(spark, d, name) for name in TABLES[:6]})


@query(f"SELECT dev_class, count(*) AS n FROM (SELECT {market.CLASS_SQL} AS dev_class FROM (SELECT (round(l_discount * 400) - 16)::DOUBLE / 100::DOUBLE AS d FROM lineitem)) GROUP BY 1")
def c04_deviation_classes(spark: SparkSession, d: str) -> DataFrame:
    return market.valuations(spark, d).groupBy(deviation_class(F.col("price_deviation")).alias("dev_class")).agg(F.count("*").alias("n"))


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL} SELECT id, current_price_minor, price_deviation, rooms FROM objects LEFT JOIN latest ON id = object_id
    WHERE current_price_minor >= 5000000 AND current_price_minor <= 40000000 AND area_sqm >= 20 AND seller_type = 'agency' AND lng BETWEEN 13 AND 17 AND lat BETWEEN 48.5 AND 50.5 AND lower(address) LIKE '%00%' ORDER BY price_deviation ASC NULLS LAST, id DESC LIMIT 100 OFFSET 20""")
def g01_list_page(spark: SparkSession, d: str) -> DataFrame:
    last = latest.top_per_key(market.valuations(spark, d), ["object_id"], [F.desc("computed_at"), F.desc("id"), F.desc("price_deviation")]).select(F.col("object_id").alias("id"), "price_deviation")
    rows = market.objects(spark, d).join(last, "id", "left")
    for predicate in catalog.filters({"price_min": 5000000, "price_max": 40000000, "area_min": 20, "seller_type": "agency", "bbox": "13,48.5,17,50.5", "q": "00"}):
        rows = rows.where(predicate)
    return rows.orderBy(*catalog.orderings()["deviation_asc"]).offset(20).limit(100).select("id", "current_price_minor", "price_deviation", "rooms")


@query(f"WITH {market.OBJECTS_SQL} SELECT id, current_price_minor FROM objects ORDER BY current_price_minor / CASE WHEN area_sqm <> 0 THEN area_sqm END DESC NULLS LAST, id DESC LIMIT 50")
def g01_per_area_order(spark: SparkSession, d: str) -> DataFrame:
    rows = market.objects(spark, d).withColumn("price_deviation", F.lit(None).cast("double"))
    return rows.orderBy(*catalog.orderings()["ppsm_desc"]).limit(50).select("id", "current_price_minor")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '1'), o_orderkey LIMIT 40")
def g07_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return queues.seeded_sample(t(spark, d, "orders"), "o_orderkey", "1", 40).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 100 < 2")
def g08_shadow_sample(spark: SparkSession, d: str) -> DataFrame:
    return queues.shadow_sample(t(spark, d, "orders"), 2, "o_orderkey").select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%1%' ORDER BY lower(n_name) = 'nation_1' DESC, n_name, n_nationkey LIMIT 20")
def g09_zone_search(spark: SparkSession, d: str) -> DataFrame:
    zones = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("external_code"))
    return catalog.zone_search(zones, "1").select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def g10_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("""SELECT 'customer' AS side, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_acctbal >= 0) AS positive FROM customer UNION ALL
    SELECT 'supplier', count(*) FILTER (WHERE s_acctbal < 0), count(*) FILTER (WHERE s_acctbal >= 0) FROM supplier""")
def h01_union_all(spark: SparkSession, d: str) -> DataFrame:
    def side(name: str, column: str) -> DataFrame:
        return t(spark, d, name).agg(F.count_if(F.col(column) < 0).alias("negative"), F.count_if(F.col(column) >= 0).alias("positive")).select(F.lit(name).alias("side"), "*")

    return side("customer", "c_acctbal").unionByName(side("supplier", "s_acctbal"))


@query("""WITH base AS (SELECT o_custkey, list(DISTINCT o_orderkey) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), new AS (SELECT o_custkey, list(DISTINCT o_orderkey) AS b FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))[1:5], ',') AS kept FROM base FULL JOIN new USING (o_custkey)""")
def h02_array_union(spark: SparkSession, d: str) -> DataFrame:
    """Both sides hold the five smallest ids at most: of a union's five smallest none lies beyond them."""
    def five(status: str, name: str) -> DataFrame:
        rows = t(spark, d, "orders").where(F.col("o_orderstatus") == status)
        return latest.top_per_key(rows, ["o_custkey"], [F.asc("o_orderkey")], 5).groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias(name))

    none = F.expr("array()").cast("array<bigint>")
    joined = five("O", "a").join(five("P", "b"), "o_custkey", "full")
    return joined.select("o_custkey", F.array_join(merging.append_distinct(F.coalesce("a", none), F.coalesce("b", none), 5), ",").alias("kept"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.z') IS NOT NULL AS has_z, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::DOUBLE IS DISTINCT FROM round(value) AS differs FROM events")
def c08_json_keys(spark: SparkSession, d: str) -> DataFrame:
    held = F.from_json("props", "map<string,string>")
    k = F.try_element_at("m", F.lit("k"))
    rows = t(spark, d, "events").withColumn("m", held)
    return rows.select("event_id", F.map_contains_key("m", "k").alias("has_k"), F.map_contains_key("m", "z").alias("has_z"), k.try_cast("long").alias("k"), (~k.try_cast("double").eqNullSafe(F.round("value"))).alias("differs"))


@query("SELECT event_id, CASE WHEN list_contains(['click', 'view'], event_type) THEN props ELSE '' END AS known, CASE WHEN list_contains(['click', 'view'], event_type) THEN '' ELSE props END AS unmapped FROM (SELECT event_id, event_type, event_type || '=' || json_extract_string(props, '$.k') AS props FROM events)")
def h05_split_map(spark: SparkSession, d: str) -> DataFrame:
    held = F.create_map("event_type", F.get_json_object("props", "$.k"))
    known, rest = merging.split_map(held, F.array(F.lit("click"), F.lit("view")))
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return t(spark, d, "events").select("event_id", show(known).alias("known"), show(rest).alias("unmapped"))


@query("""SELECT event_id, k1 AS a, k2 AS b FROM (SELECT event_id, CASE WHEN event_type = 'a' THEN 0 ELSE round(value * 100)::BIGINT END AS k1, json_extract_string(props, '$.k')::BIGINT AS k2 FROM events)""")
def h04_merge_map(spark: SparkSession, d: str) -> DataFrame:
    left = F.create_map(F.lit("a"), market.cents("value"), F.lit("b"), F.lit(-1).cast("long"))
    right = F.create_map(F.lit("b"), F.get_json_object("props", "$.k").cast("long"))
    merged = merging.merge_maps(left, right)
    return t(spark, d, "events").select("event_id", F.element_at(merged, "a").alias("a"), F.element_at(merged, "b").alias("b"))


_SPLIT = "base AS (SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS minor FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), delta AS (SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS minor FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def half(condition: str) -> DataFrame:
        return t(spark, d, "orders").where(condition).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(market.cents("o_totalprice")).alias("minor"))

    return half("o_orderkey % 3 > 0"), half("o_orderkey % 3 = 0")


@query(f"WITH {_SPLIT} SELECT o_custkey, coalesce(d.n, b.n) AS n, coalesce(d.minor, b.minor) AS minor FROM base b FULL JOIN delta d USING (o_custkey)")
def b02_upsert(spark: SparkSession, d: str) -> DataFrame:
    return merging.upsert(*_halves(spark, d), ["o_custkey"])


@query(f"WITH {_SPLIT} SELECT o_custkey, coalesce(d.n, 0) + coalesce(b.n, 0) AS n, coalesce(d.minor, 0) + coalesce(b.minor, 0) AS minor FROM base b FULL JOIN delta d USING (o_custkey)")
def b03_upsert_adding(spark: SparkSession, d: str) -> DataFrame:
    return merging.upsert_adding(*_halves(spark, d), ["o_custkey"], ["n", "minor"])


@query(f"WITH {_SPLIT} SELECT o_custkey, coalesce(b.n, d.n) AS n, coalesce(b.minor, d.minor) AS minor FROM base b FULL JOIN delta d USING (o_custkey)")
def b04_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    return merging.insert_absent(*_halves(spark, d), ["o_custkey"], [F.asc("n")])


@query("""WITH base AS (SELECT l_orderkey, l_linenumber::INTEGER AS ord, l_partkey FROM lineitem WHERE l_returnflag <> 'R'), changed AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P')
    SELECT l_orderkey, ord, l_partkey FROM base WHERE l_orderkey NOT IN (SELECT o_orderkey FROM changed) UNION ALL SELECT o_orderkey, unnest([1, 2])::INTEGER, unnest([o_custkey, o_custkey + 1]) FROM changed""")
def b07_replace_children(spark: SparkSession, d: str) -> DataFrame:
    base = t(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").alias("ord"), "l_partkey")
    changed = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_custkey", F.col("o_custkey") + 1).alias("v"))
    return merging.replace_children(base, changed, "l_orderkey", "v", "l_partkey")


@query("""WITH delta AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c, o_orderstatus || 'x' AS s, o_orderkey % 7 = 0 AS flag FROM orders WHERE o_orderkey % 3 = 0)
    SELECT b.o_orderkey, coalesce(d.c, b.o_custkey) AS o_custkey, CASE WHEN b.o_orderkey % 5 = 0 THEN b.o_orderstatus ELSE coalesce(d.s, b.o_orderstatus) END AS o_orderstatus, (b.o_orderkey % 4 = 0) OR coalesce(d.flag, false) AS flag FROM orders b LEFT JOIN delta d USING (o_orderkey)""")
def b08_update_known(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders")
    base = orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "fetched").alias("detail"), (F.col("o_orderkey") % 4 == 0).alias("flag"))
    delta = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("o_custkey"), F.concat("o_orderstatus", F.lit("x")).alias("o_orderstatus"), (F.col("o_orderkey") % 7 == 0).alias("flag"))
    return merging.update_known(base, delta, "o_orderkey", ["o_custkey"], ["o_orderstatus"], "detail", sticky=["flag"]).drop("detail")


@query("""WITH obs AS (SELECT user_id, event_type, event_id, ts, round(value)::BIGINT AS price FROM events) SELECT event_id, price FROM obs QUALIFY price IS DISTINCT FROM lag(price) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def k01_price_changes(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.operators.asof import price_changes

    rows = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.round("value").cast("long").alias("price"))
    return price_changes(rows, ["user_id", "event_type"], "ts", "event_id", "price").select("event_id", "price")


@query("""SELECT o_orderkey, CASE WHEN price IS NULL THEN 'no_price' WHEN currency IS NULL THEN 'no_currency' WHEN currency <> 'EUR' THEN 'currency_mismatch' WHEN area IS NULL OR area <= 0 THEN 'no_area' WHEN zone IS NULL THEN 'no_zone' WHEN kind = '' THEN 'no_type' END AS reason FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS price, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'CZK' ELSE 'EUR' END AS currency, o_orderkey % 8 AS area, CASE WHEN o_orderkey % 7 > 0 THEN 1 END AS zone, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'flat' END AS kind FROM orders)""")
def c14_missing_reason(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.functions.classes import missing_reason

    k = F.col("o_orderkey")
    reason = missing_reason(F.when(k % 10 > 0, F.col("o_totalprice")), F.when(k % 9 == 1, "CZK").when(k % 9 > 1, "EUR"), F.lit("EUR"), k % 8, F.when(k % 7 > 0, 1), F.when(k % 6 == 0, "").otherwise("flat"))
    return t(spark, d, "orders").select("o_orderkey", reason.alias("reason"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1")
def c13_trailing_days(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return t(spark, d, "events").where((F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < as_of)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(min(p) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < p, false) AS moved_forward FROM (SELECT *, ts::DATE - (event_id * 7 % 30)::INTEGER AS p FROM events)")
def c26_moved_forward(spark: SparkSession, d: str) -> DataFrame:
    """Events as sightings that say a date of posting up to 29 days before."""
    from hearthline.operators.delisting import moved_forward

    rows = t(spark, d, "events").select("event_id", "user_id", "event_type", F.date_sub(F.to_date("ts"), (F.col("event_id") * 7 % 30).cast("int")).alias("posted_at"))
    return moved_forward(rows, ["user_id", "event_type"], "event_id", "posted_at").select("event_id", "moved_forward")


@query("""WITH gaps AS (SELECT c_custkey, k AS attr_key FROM customer CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) r(k)) SELECT c_custkey, attr_key FROM gaps WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = attr_key)""")
def c24_missing_attributes(spark: SparkSession, d: str) -> DataFrame:
    from hearthline.operators.rules import missing_attributes

    things = t(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.lit("CZ").alias("country"), F.expr("cast(map() as map<string,string>)").alias("attributes"))
    registry = spark.createDataFrame([("CZ", k) for k in ("click", "view", "purchase")], "country string, key string")
    known = t(spark, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("attr_key"))
    return missing_attributes(things, registry, known).withColumnRenamed("object_id", "c_custkey")
