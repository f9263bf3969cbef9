"""Queries over written tables and rule books: keyed upserts, trigram search, very many rules, promotion by replay, positions and classes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import geo
from hearthline.operators import catalog, probing, queues, rules
from hearthline.operators.merging import upsert, upsert_adding
from hearthline.operators.trigrams import TrigramIndex
from hearthline.plans import market
from hearthline.plans.registry import query
from hearthline.session import shared_folder
from hearthline.sources.tables import table as t
from hearthline.streaming import states
from hearthline.streaming.sinks import KeyedTable


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey AS k, CASE WHEN count(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) > 0 THEN 1000 + max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) ELSE c_nationkey END::BIGINT AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey")
def b02_keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a keyed table, into which the latest odd order of each is merged; the second batch comes twice."""
    base = t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    table = KeyedTable(spark, _place(spark, "keyed"), base.schema, ("k",), 16)
    merge = lambda old, new: upsert(old, new, ["k"])
    table.apply(base, merge, 0)
    changes = t(spark, d, "orders").where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").cast("long").alias("k")).agg((1000 + F.max("o_orderkey")).cast("long").alias("v"))
    table.apply(changes, merge, 1)
    table.apply(changes, merge, 1)
    return table.read()


@query("SELECT l_suppkey AS k, count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
def b03_keyed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that three batches add to, each of which is run again after the next."""
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("k"), "l_orderkey", F.col("l_linenumber").cast("long").alias("lines"))
    parts = [rows.where(F.pmod("l_orderkey", F.lit(3)) == i).groupBy("k").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")) for i in range(3)]
    table = KeyedTable(spark, _place(spark, "counters"), parts[0].schema, ("k",), 16)
    add = lambda old, new: upsert_adding(old, new, ["k"], ["n", "lines"])
    for batch, part in enumerate(parts):
        table.apply(part, add, batch)
        table.apply(part, add, batch)
    return table.read()


_TERMS = ["all ri", "Gizmo", "ed ", "zzz", "t g", "ing"]


@query(f"SELECT term, p_partkey FROM part, (SELECT unnest({_TERMS!r}) AS term) WHERE contains(lower(p_name), lower(term))")
def c06_trigram_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds a term, by an index of trigrams."""
    rows = t(spark, d, "part").select("p_partkey", "p_name")
    index = TrigramIndex(spark, _place(spark, "trigrams"), rows.schema["p_partkey"].dataType, 32)
    index.add(rows, "p_partkey", "p_name")
    found = [index.search(rows, "p_partkey", "p_name", term).select(F.lit(term).alias("term"), "p_partkey") for term in _TERMS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_RULE_ID = "ascii(substr({w}, 1, 1)) * 10000 + ascii(substr({w}, 2, 1)) * 100 + coalesce(ascii(nullif(substr({w}, 3, 1), '')), 0)"


@query(rf"""WITH words AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+')) AS w FROM documents), hits AS (SELECT doc_id, w, ({_RULE_ID.format(w='w')})::BIGINT AS rule_id, ascii(w) % 20 AS k FROM words WHERE regexp_full_match(w, '[a-z]{{2,3}}'))
    SELECT doc_id AS object_id, 'k' || k AS attr_key, arg_min(w, rule_id) AS value, min(rule_id) AS rule_id FROM hits GROUP BY doc_id, k""".replace("\\\\", "\\"))
def i23_word_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each word of two or three letters that a document holds as a rule of its own, loaded from a table of templates."""
    docs = t(spark, d, "documents")
    w = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"))).alias("w")
    words = docs.select(w).where(F.col("w").rlike("^[a-z]{2,3}$")).distinct()
    word = F.col("w")
    letter = lambda k: F.coalesce(F.ascii(F.nullif(F.substring(word, k, 1), F.lit(""))), F.lit(0))
    templates = words.select((letter(1) * 10000 + letter(2) * 100 + letter(3)).cast("long").alias("id"), F.lit("CZ").alias("country"), F.concat(F.lit("k"), F.ascii(word) % 20).alias("attr_key"), F.lit("literal").alias("pattern_type"), word.alias("pattern"), word.alias("value"),
                             F.lit("active").alias("status"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("promoted_at"))
    registry = words.sparkSession.createDataFrame([], "country string, key string, value_min double, value_max double")
    book = rules.load(templates, registry, "CZ")
    texts = docs.select(F.col("doc_id").alias("object_id"), F.lit("").alias("title"), F.col("text").alias("description"))
    return rules.apply_rules(texts, book, sorted({r.key for r in book})).select("object_id", "attr_key", "value", "rule_id")


@query("""WITH e AS (SELECT p_partkey AS o, p_name AS pattern, CASE WHEN p_partkey % 97 = 0 THEN 'no' ELSE 'yes' END AS v, CASE WHEN p_partkey % 13 = 0 THEN 'no' ELSE 'yes' END AS held, p_partkey % 11 > 0 AS fires FROM part),
    f AS (SELECT pattern, arg_min(v, o) AS value FROM e GROUP BY 1), j AS (SELECT e.*, value, v = value AS ok FROM e JOIN f USING (pattern)),
    c AS (SELECT pattern, value, count(*) FILTER (NOT ok) AS conflicts, count(*) FILTER (ok) AS occurrences FROM j GROUP BY ALL),
    l AS (SELECT pattern, bool_and(fires AND held = value) AS good, count(*) AS n FROM (SELECT * FROM j WHERE ok QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY o DESC) <= 2) GROUP BY 1),
    p AS (SELECT c.*, CASE WHEN conflicts > 0 THEN 'conflict' WHEN occurrences >= 2 AND n = 2 AND good THEN 'active' ELSE 'candidate' END AS status FROM c LEFT JOIN l USING (pattern)),
    w AS (SELECT pattern, count(*) AS wrong FROM j JOIN p USING (pattern) WHERE p.status = 'active' AND o % 5 = 0 AND held <> j.value GROUP BY 1)
    SELECT pattern, p.value AS value, CASE WHEN wrong > 0 THEN 'demoted' ELSE status END AS status, occurrences::BIGINT AS occurrences, conflicts::BIGINT AS conflicts, coalesce(wrong, 0)::BIGINT AS mismatches FROM p LEFT JOIN w USING (pattern)""")
def k08_rule_life(spark: SparkSession, d: str) -> DataFrame:
    """Rules mined from the names of parts, replayed on their latest confirmations, promoted, and checked against what every fifth part holds."""
    k = F.col("p_partkey")
    said = F.concat(F.lit("A "), F.col("p_name"), F.lit(" for sale"))
    parts = t(spark, d, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # groups that hold text are sorted in each task, and a million parts lie in one
    events = parts.select(k.alias("seq"), F.lit("CZ").alias("country"), F.lit("handy").alias("attr_key"), F.col("p_name").alias("pattern"), F.col("p_name").alias("quote"), said.alias("text"), F.when(k % 97 == 0, "no").otherwise("yes").alias("value"), F.lit(0.9).alias("confidence"), k.cast("long").alias("object_id"))
    none = spark.createDataFrame([], "country string, attr_key string, pattern string, value string, status string, confidence double, occurrences long, conflicts long, example_object_ids array<long>, last_ids array<long>")
    mined = rules.mine(none, events)
    objects = parts.select(k.alias("object_id"), F.lit("").alias("title"), F.when(k % 11 > 0, said).otherwise("sold").alias("description"))
    current = parts.select(k.cast("long").alias("object_id"), F.lit("handy").alias("attr_key"), F.when(k % 13 == 0, "no").otherwise("yes").alias("value"))
    live = rules.promoted(mined, objects, current, F.lit(dt.datetime(2026, 1, 1)), 2).withColumns({"id": F.col("pattern"), "shadow_mismatches": F.lit(0).cast("long")})
    seen = events.where("object_id % 5 = 0").join(live.where("status = 'active'").select("pattern", F.col("value").alias("template_value")), "pattern").select(F.col("pattern").alias("template_id"), "object_id", "attr_key", "template_value")
    checks = seen.withColumns({"status": F.lit("pending"), "llm_value": F.lit(None).cast("string")})
    verdicts = seen.select("template_id", "object_id", "attr_key").join(current.withColumnRenamed("value", "llm_value"), ["object_id", "attr_key"])
    after, _ = rules.settle_shadow(live, checks, verdicts)
    return after.select("pattern", "value", "status", "occurrences", "conflicts", F.col("shadow_mismatches").alias("mismatches"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS c, o_orderkey % 3 AS m FROM orders)
    SELECT id, CASE WHEN c = 0 THEN 'alive' WHEN c = 1 THEN CASE WHEN m = 0 THEN 'gone' ELSE 'pending' END WHEN c = 2 THEN CASE WHEN m < 2 THEN 'blocked' ELSE 'pending' END ELSE 'pending' END AS class FROM r""")
def i36_two_run_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes that count at once, and ones that have to be seen twice, an hour apart."""
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, "alive").when(k % 4 == 1, "gone").when(k % 4 == 2, "blocked").otherwise("").alias("observed"), F.when(k % 3 == 0, "gone").otherwise("alive").alias("previous"),
        F.when((k % 4 == 2) & (k % 3 < 2), "was blocked before").alias("reason"), F.when(k % 3 < 2, 90).otherwise(10).alias("minutes"))
    return rows.select("id", queues.confirmed_class("observed", "previous", "reason", "minutes", ["gone", "blocked"]).alias("class"))


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 5 > 0 AS known, c_custkey % 7 > 0 AS found, c_custkey % 4 * 0.2::DOUBLE AS off, c_custkey % 11 > 0 AS place, c_custkey % 2 = 0 AS street,
        CASE c_custkey % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'municipality' ELSE CASE WHEN c_custkey % 20 >= 16 THEN 'street' WHEN c_custkey % 20 >= 13 THEN 'municipality' WHEN c_custkey % 20 >= 1 THEN 'postcode' END END AS own,
        CASE c_custkey % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'street' WHEN 2 THEN 'municipality' END AS theirs FROM customer),
    t AS (SELECT *, found AND place AND (NOT known OR (street AND off < 0.45 AND coalesce(theirs IN ('street', 'building'), false) AND NOT coalesce(own = 'street', false))) AS take FROM r)
    SELECT k, CASE WHEN take THEN 50 + off WHEN known THEN 50 END::DOUBLE AS lat, CASE WHEN take THEN theirs WHEN known THEN own END AS level, CASE WHEN take THEN 'geocoder' WHEN known THEN 'source' END AS source FROM t""")
def i18_resolved_positions(spark: SparkSession, d: str) -> DataFrame:
    """A source's point or a geocoder's, by level, distance and what was asked for."""
    k = F.col("c_custkey")
    level = F.when(k % 3 == 0, "street").when(k % 3 == 1, "municipality")
    kind = F.when(k % 6 == 0, "house").when(k % 6 == 1, "road").when(k % 6 == 2, "town").otherwise("sea")
    own, theirs = F.when(k % 5 > 0, 50.0), F.when(k % 7 > 0, 50 + (k % 4) * 0.2)
    got = geo.resolve_position(own, F.when(k % 5 > 0, 14.0), level, k % 20, theirs, F.when(k % 7 > 0, 14.0), kind, k % 11 > 0, k % 2 == 0)
    return t(spark, d, "customer").select(k.alias("k"), got["lat"].alias("lat"), got["level"].alias("level"), got["source"].alias("source"))


@query("""WITH last AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1), pts AS (SELECT round(value * 100)::BIGINT AS p, ts, event_id FROM events WHERE user_id = (SELECT user_id FROM last)),
    ls AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = (SELECT user_id FROM last))
    SELECT c_custkey AS id, c_name AS name, (SELECT string_agg(p::VARCHAR, ',' ORDER BY ts, event_id) FROM pts) AS prices, coalesce((SELECT string_agg(o_orderpriority || '/' || o_orderkey, ',' ORDER BY o_orderpriority, o_orderkey::VARCHAR) FROM ls), '') AS listings FROM customer WHERE c_custkey = (SELECT user_id FROM last)""")
def m_object_view(spark: SparkSession, d: str) -> DataFrame:
    """A customer with all prices and listings: the one with most events."""
    events, orders = t(spark, d, "events"), t(spark, d, "orders")
    asked = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    history = events.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("id"), F.col("ts").alias("change_at"), F.round(F.col("value") * 100).cast("long").alias("price_minor"), F.lit("EUR").alias("currency"))
    listings = orders.select(F.col("o_custkey").alias("object_id"), F.substring("o_orderpriority", 1, 1).alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.lit(None).cast("string").alias("source_url"))
    sources = orders.select(F.substring("o_orderpriority", 1, 1).alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    view = catalog.object_view(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), history, listings, sources, asked)
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    return view.select("id", "name", join("price_history", lambda p: p["price_minor"].cast("string")).alias("prices"), join("listings", lambda r: F.concat_ws("/", r["source_name"], r["external_id"])).alias("listings"))


_MODEL_ASKED = [{}, {"country": "C1"}, {"deal_type": "rent"}, {"country": "C3", "deal_type": "sale"}, {"country": "C9"}, {"country": "C22"}, {"deal_type": "lease"}, {"zone": "1"}]


@query("""WITH m AS (SELECT o_orderkey AS id, 'C' || o_custkey % 5 AS country, CASE WHEN o_orderkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal_type, o_orderdate AS ts FROM orders), asked(n, country, deal) AS (VALUES (0, NULL, NULL), (1, 'C1', NULL), (2, NULL, 'rent'), (3, 'C3', 'sale'), (4, 'C9', NULL)),
    found AS (SELECT n, max({'ts': ts, 'id': id}).id AS id FROM asked a JOIN m ON (a.country IS NULL OR a.country = m.country) AND (a.deal IS NULL OR a.deal = m.deal_type) GROUP BY n)
    SELECT n::INTEGER AS n, id, NULL AS error FROM found UNION ALL SELECT * FROM (VALUES (5, NULL, 'country: a code of two letters'), (6, NULL, 'deal_type: sale | rent'), (7, NULL, 'unknown parameter: zone'))""")
def m_latest_model(spark: SparkSession, d: str) -> DataFrame:
    """The latest model for several requests, and what is wrong with others."""
    models = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), F.col("o_custkey") % 5).alias("country"), F.when(F.col("o_orderkey") % 2 == 0, "sale").otherwise("rent").alias("deal_type"), F.col("o_orderdate").alias("computed_at"))
    out = spark.createDataFrame([], "n int, id long, error string")
    for n, params in enumerate(_MODEL_ASKED):
        try:
            out = out.unionByName(catalog.latest_model(models, params).select(F.lit(n).alias("n"), "id", F.lit(None).cast("string").alias("error")))
        except ValueError as e:
            out = out.unionByName(spark.createDataFrame([(n, None, str(e))], "n int, id long, error string"))
    return out


_LIST_ASKED = [{}, {"country": ""}, {"rooms": "2"}, {"price_min": "20000000", "status": "active"}, {"colour": "red"}, {"rooms": "many"}, {"price_min": "5", "price_max": "4"}, {"q": "x"}]


@query(f"""WITH {market.OBJECTS_SQL} SELECT 0::INTEGER AS n, count(*) AS total, NULL AS error FROM objects UNION ALL SELECT 1, count(*), NULL FROM objects UNION ALL SELECT 2, count(*) FILTER (WHERE rooms = 2), NULL FROM objects UNION ALL SELECT 3, count(*) FILTER (WHERE current_price_minor >= 20000000 AND status = 'active'), NULL FROM objects
    UNION ALL SELECT * FROM (VALUES (4, NULL, 'unknown parameter: colour'), (5, NULL, 'rooms: not a number'), (6, NULL, 'price_min > price_max: 5 > 4'), (7, NULL, 'q: at least 2 characters'))""")
def c03_requests(spark: SparkSession, d: str) -> DataFrame:
    """Totals of list requests whose filters are optional, and what is wrong with others."""
    photos = spark.createDataFrame([], "object_id long, ord int, original_url string")
    out = spark.createDataFrame([], "n int, total long, error string")
    for n, params in enumerate(_LIST_ASKED):
        try:
            _, total = catalog.list_objects(market.objects(spark, d), market.valuations(spark, d), photos, params)
            out = out.unionByName(total.select(F.lit(n).alias("n"), "total", F.lit(None).cast("string").alias("error")))
        except ValueError as e:
            out = out.unionByName(spark.createDataFrame([(n, None, str(e))], "n int, total long, error string"))
    return out


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_orderkey % 35 AS n, o_orderkey % 3 = 0 AS full_ FROM orders)
    SELECT id, CASE WHEN k = 0 THEN 'direct' WHEN k = 1 THEN 'mirror' WHEN k = 2 THEN 'agency_site' WHEN k = 3 THEN 'excluded_no_data' WHEN n >= 30 AND full_ THEN 'direct' ELSE 'excluded_no_data' END AS class FROM r""")
def i37_probe_classes(spark: SparkSession, d: str) -> DataFrame:
    """Finished probes: observed classes, mirrors and agencies by their home page, another country, complete samples."""
    k, kind, n = F.col("o_orderkey"), F.col("o_orderkey") % 7, F.col("o_orderkey") % 35
    home = F.when(kind == 1, F.repeat(F.lit("<a href=//x.CeskeReality.cz>"), 5)).when(kind == 2, "<title>Century 21 Brno").otherwise(F.repeat(F.lit("ceskereality "), 4))
    some = F.when(k % 3 == 0, n).otherwise(n - 1)
    coverage = F.struct(n.alias("n"), n.alias("external_id"), n.alias("url"), some.alias("price"), n.alias("deal_type"), n.alias("property_type"))
    return t(spark, d, "orders").select(k.alias("id"), probing.probe_class(F.when(kind == 0, "direct").otherwise("pending"), home, F.when(kind == 3, "a.sk").otherwise("a.cz"), coverage).alias("class"))


@query("""WITH e AS (SELECT p_partkey AS o, p_name AS pattern, CASE WHEN p_partkey % 97 = 0 THEN 'no' ELSE 'yes' END AS v, length(p_name) % 3 AS kind FROM part), h AS (SELECT DISTINCT pattern, kind, CASE kind WHEN 1 THEN 'yes' ELSE 'no' END AS value, CASE kind WHEN 1 THEN 'active' ELSE 'disabled' END AS status FROM e WHERE kind > 0),
    f AS (SELECT pattern, kind, arg_min(v, o) AS first FROM e GROUP BY ALL), j AS (SELECT f.pattern, f.kind, coalesce(h.value, f.first) AS value, coalesce(h.status, 'candidate') AS status FROM f LEFT JOIN h USING (pattern)),
    c AS (SELECT j.pattern, j.kind, j.value, j.status, count(*) FILTER (e.v = j.value) AS yes, count(*) FILTER (e.v <> j.value) AS no FROM j JOIN e USING (pattern) GROUP BY ALL)
    SELECT pattern, value, CASE WHEN no > 0 AND status IN ('candidate', 'active') THEN 'conflict' ELSE status END AS status, CASE kind WHEN 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, (yes + CASE WHEN kind > 0 THEN 3 ELSE 0 END)::BIGINT AS occurrences, no::BIGINT AS conflicts FROM c""")
def b05_mined_into(spark: SparkSession, d: str) -> DataFrame:
    """Mined events merged into templates that are active or disabled, and new ones."""
    k = F.col("p_partkey")
    parts = t(spark, d, "part")
    events = parts.select(k.alias("seq"), F.lit("CZ").alias("country"), F.lit("handy").alias("attr_key"), F.col("p_name").alias("pattern"), F.col("p_name").alias("quote"), F.col("p_name").alias("text"), F.when(k % 97 == 0, "no").otherwise("yes").alias("value"), F.lit(0.9).alias("confidence"), k.cast("long").alias("object_id"))
    kind, none = F.length("p_name") % 3, F.expr("cast(array() as array<bigint>)")
    held = parts.select("p_name").distinct().where(kind > 0).select(
        F.lit("CZ").alias("country"), F.lit("handy").alias("attr_key"), F.col("p_name").alias("pattern"), F.when(kind == 1, "yes").otherwise("no").alias("value"), F.when(kind == 1, "active").otherwise("disabled").alias("status"), F.when(kind == 1, 0.5).otherwise(0.95).alias("confidence"),
        F.lit(3).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("conflicts"), none.alias("example_object_ids"), none.alias("last_ids"))
    return rules.mine(held, events).select("pattern", "value", "status", "confidence", "occurrences", "conflicts")


@query("""WITH e AS (SELECT user_id, ts, event_type <> 'error' AND event_type <> 'view' AS found, event_id FROM events), g AS (SELECT *, count(*) FILTER (found) OVER w AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, count(*) FILTER (NOT found) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS misses FROM g), p AS (SELECT *, lag(misses) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM m)
    SELECT user_id AS object_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS run_at, CASE WHEN found THEN 'active' ELSE 'delisted' END AS status FROM p WHERE (NOT found AND misses = 2) OR (found AND before >= 2)""")
def k02_lifecycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as sightings, streamed in three parts in order of time: an object is delisted at its second miss and comes back when it is seen."""
    rows = t(spark, d, "events").select(F.col("user_id").cast("long").alias("object_id"), F.col("ts").cast("timestamp").alias("run_at"), (~F.col("event_type").isin("error", "view")).alias("found"))
    ends = rows.agg(F.min(F.unix_micros("run_at")).alias("a"), F.max(F.unix_micros("run_at")).alias("b")).first()
    at, place = F.unix_micros("run_at"), _place(spark, "sightings")
    edges = [ends["a"] + (ends["b"] - ends["a"]) * k // 3 for k in range(3)] + [ends["b"] + 1]
    for low, high in zip(edges, edges[1:]):
        rows.where((at >= low) & (at < high)).write.mode("append").parquet(f"{place}/in/{low}")
        stream = states.lifecycle(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{place}/in"))
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select("object_id", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("run_at"), "status")


@query(f"""WITH {market.OBJECTS_SQL} SELECT id FROM objects WHERE country = 'NATION_3' AND deal_type = 'sale' AND status = 'active'""")
def c18_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The objects that a market's model learns from."""
    return catalog.corpus(market.objects(spark, d), "NATION_3", "sale").select("id")


@query(f"""WITH {market.OBJECTS_SQL}, {market.HISTORY_SQL}, v AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, l_linenumber, l_discount, l_quantity, l_extendedprice, l_shipdate FROM lineitem ORDER BY l_orderkey, l_shipdate DESC, l_linenumber * 1000000 + l_partkey DESC),
    h AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, l_tax, l_linenumber * 1000000 + l_partkey AS days, l_shipdate FROM lineitem WHERE l_orderkey % 2 = 0 ORDER BY l_orderkey, l_shipdate DESC, l_linenumber * 1000000 + l_partkey DESC),
    c AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS ord FROM lineitem WHERE l_orderkey % 3 = 0 ORDER BY l_orderkey, ord), p AS (SELECT object_id, arg_min(price_minor, (change_at, id)) AS p0, arg_max(price_minor, (change_at, id)) AS p1, count(*) AS n FROM history GROUP BY 1),
    z AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey % 4 > 0)
    SELECT o.id, o.country, o.deal_type, o.zone_id, 'T' || o.id AS title, o.address, o.area_sqm, o.rooms, 'flat' AS property_type, o.seller_type, NULL AS seller_name, o.current_price_minor, o.currency, o.status, CASE WHEN o.status = 'delisted' THEN 'gone' END AS delisted_reason,
        strftime(o.first_seen_at, '%Y-%m-%d') AS first_seen_at, NULL AS last_seen_at, NULL AS delisted_at, o.address AS description_original, 'cs' AS language_original, CASE WHEN o.id % 5 > 0 THEN 'street' END AS geo_confidence, p0 AS first_price, p1 AS last_price, n AS n_points,
        z.name AS zone_name, CASE WHEN z.id IS NOT NULL THEN 'zone' END AS zone_level, CASE WHEN z.id IS NOT NULL THEN 'osm' END AS zone_source,
        CASE WHEN o.id % 5 > 0 THEN 'm' || v.l_linenumber END AS model_version, CASE WHEN o.id % 5 > 0 THEN v.l_discount END AS price_deviation, CASE WHEN o.id % 5 > 0 AND v.l_linenumber % 3 = 0 THEN 'no_price' END AS deviation_null_reason, CASE WHEN o.id % 5 > 0 THEN round(v.l_extendedprice * 100)::BIGINT END AS predicted_price_minor,
        CASE WHEN o.id % 5 > 0 THEN round(v.l_extendedprice * 100)::BIGINT - 500 END AS interval_low_minor, CASE WHEN o.id % 5 > 0 THEN round(v.l_extendedprice * 100)::BIGINT + 500 END AS interval_high_minor, CASE WHEN o.id % 5 > 0 THEN v.l_quantity::BIGINT END AS sample_size, CASE WHEN o.id % 5 > 0 THEN v.l_discount * 2 END AS r_squared,
        CASE WHEN o.id % 5 > 0 THEN v.l_linenumber % 2 = 0 END AS zone_fallback, CASE WHEN o.id % 5 > 0 THEN strftime(v.l_shipdate, '%Y-%m-%d') END AS valued_at, h.days AS horizon_days, h.l_tax AS hazard_probability, NULL AS hazard_null_reason, CASE WHEN h.k IS NOT NULL THEN 'h1' END AS hazard_model_version, CASE WHEN h.k IS NOT NULL THEN 7 END AS events_in_training, strftime(h.l_shipdate, '%Y-%m-%d') AS hazard_at,
        CASE WHEN o.id % 12 = 0 AND o.id % 8 > 0 THEN 'ru ' || o.id END AS ru_text, CASE WHEN o.id % 12 = 0 AND o.id % 8 > 0 THEN 'gpt' END AS ru_model, CASE WHEN o.id % 12 = 0 AND o.id % 8 > 0 THEN o.id END AS ru_tokens, NULL AS ru_at, CASE WHEN o.id % 4 = 0 AND o.id % 8 > 0 THEN 'en ' || o.id END AS en_text, CASE WHEN o.id % 4 = 0 AND o.id % 8 > 0 THEN 'gpt' END AS en_model,
        CASE WHEN o.id % 4 = 0 AND o.id % 8 > 0 THEN o.id END AS en_tokens, NULL AS en_at, c.ord AS cover_ord, 'u' || c.ord AS cover_url, 'c' || c.ord AS cover_card, NULL AS cover_list, o.id % 5 = 0 AS not_modeled, o.lat AS geo_y, o.lng AS geo_x
    FROM objects o LEFT JOIN v ON v.k = o.id LEFT JOIN h ON h.k = o.id LEFT JOIN c ON c.k = o.id LEFT JOIN p ON p.object_id = o.id LEFT JOIN z ON z.id = o.zone_id""")
def c01_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """All columns of a list's rows."""
    k, none = F.col("l_orderkey"), F.lit(None).cast("string")
    lines = t(spark, d, "lineitem").withColumn("nr", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    values = lines.select(k.alias("object_id"), F.col("nr").alias("id"), F.concat(F.lit("m"), "l_linenumber").alias("model_version"), F.col("l_discount").alias("price_deviation"), F.when(F.col("l_linenumber") % 3 == 0, "no_price").alias("null_reason"), cents.alias("predicted_price_minor"),
                          (cents - 500).alias("interval_low_minor"), (cents + 500).alias("interval_high_minor"), F.col("l_quantity").cast("long").alias("sample_size"), (F.col("l_discount") * 2).alias("r_squared"), (F.col("l_linenumber") % 2 == 0).alias("zone_fallback"), F.col("l_shipdate").alias("computed_at"))
    hazards = lines.where(k % 2 == 0).select(k.alias("object_id"), F.col("nr").alias("horizon_days"), F.col("l_tax").alias("hazard_probability"), none.alias("null_reason"), F.lit("h1").alias("model_version"), F.lit(7).alias("events_in_training"), F.col("l_shipdate").alias("computed_at"))
    photos = lines.where(k % 3 == 0).select(k.alias("object_id"), F.col("nr").alias("ord"), F.concat(F.lit("u"), "nr").alias("original_url"), F.concat(F.lit("c"), "nr").alias("file_card"), none.alias("file_list"))
    i = F.col("id")
    rows = market.objects(spark, d)
    rows = rows.withColumns({"title": F.concat(F.lit("T"), i), "property_type": F.lit("flat"), "seller_name": none, "delisted_reason": F.when(F.col("status") == "delisted", "gone"), "last_seen_at": none, "delisted_at": none, "description_original": F.col("address"), "language_original": F.lit("cs"), "geo_confidence": F.when(i % 5 > 0, "street")})
    said = rows.where(i % 4 == 0).select(i.alias("object_id"), F.explode(F.when(i % 12 == 0, F.array(F.lit("ru"), F.lit("en"))).otherwise(F.array(F.lit("en")))).alias("lang"), F.sha2(F.when(i % 8 == 0, "old").otherwise(F.col("address")), 256).alias("source_hash"))
    said = said.select("*", F.concat_ws(" ", "lang", F.col("object_id").cast("string")).alias("text"), F.lit("gpt").alias("model"), F.col("object_id").alias("token_cost"), none.alias("translated_at"))
    zones = t(spark, d, "nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("zone").alias("level"), F.lit("osm").alias("source"))
    got = catalog.list_projection(rows, zones, values, hazards, market.history(spark, d), photos, said)
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen_at", "valued_at", "hazard_at")})
