"""Queries of parsers, feeds, list pages and upkeep over pages and records made from the test tables (inventory A, B, C, D, E, I, K, L, M)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import attributes, money, scheduling, text, urls
from hearthline.operators import asof, catalog, configs, delisting, gram, probing, quality, queues, rules, scheduling as crawl, spatial
from hearthline.plans import market
from hearthline.plans.registry import query
from hearthline.sources import feeds, pages
from hearthline.sources.tables import spread, table as t

AS_OF = dt.datetime(1999, 6, 1)


def _filled(template: str, **columns) -> F.Column:
    """A template with columns in place of {name}."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head.replace("«", "{").replace("»", "}")), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest.replace("«", "{").replace("»", "}")))


# A: pages and feeds -------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, unnest(generate_series(1, greatest(ceil(n / 20.0), 1)::INTEGER))::INTEGER AS page FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def a05_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", F.explode(pages.page_numbers(F.col("n"))).alias("page"))


@query("""SELECT o_orderkey, o_orderkey::VARCHAR AS external_id, '/inzerat/' || o_orderkey || '/x.php' AS url, strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderkey % 7 > 1 THEN floor(o_totalprice)::BIGINT * 100 END AS price_minor,
    CASE WHEN o_orderkey % 7 > 1 THEN 'CZK' END AS currency, 'Praha ' || o_orderkey % 10 || ', 150 00' AS address, 'Byt & ' || o_orderpriority AS description, CASE WHEN o_orderkey % 7 = 1 THEN 'unknown_price: Zeptejte se' END AS problem FROM orders""")
def a06_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, "Dohodou").when(k % 7 == 1, "Zeptejte se").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(" Kč")))
    card = _filled('<h2><a href="/inzerat/{k}/x.php">t</a></h2> [{day}. {year}]<div class="popis">Byt &amp; {prio}</div><div class="inzeratycena"><b>{price}</b></div><div class="inzeratylok">Praha {place}<br>150 00</div></div>',
                   k=k, day=F.date_format("o_orderdate", "d.M"), year=F.year("o_orderdate"), prio=F.col("o_orderpriority"), price=price, place=k % 10)
    found = pages.cards(t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("<html>head" + pages.CARD), card).alias("html")))
    return found.select("o_orderkey", "external_id", "url", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "price_minor", "currency", "address", "description", "problem")


@query("""SELECT s_suppkey, 'Byt ' || s_name AS title, (floor(abs(s_acctbal)) + 1)::BIGINT * 100 AS price_minor, 'CZK' AS currency, s_name AS seller_name, 50::DOUBLE + (s_suppkey % 100)::DOUBLE / 100 AS lat, 14.25::DOUBLE AS lng, 16 AS zoom,
    '150 00' AS postcode, (s_suppkey % 50)::INTEGER AS views, 2 AS n_photos, CASE WHEN s_suppkey % 9 = 0 THEN 'no_description' END AS problem, CASE WHEN s_suppkey % 9 > 0 THEN (s_suppkey % 90 + 10) || ' m²' END AS plot FROM supplier""")
def a08_details(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.when(k % 9 > 0, _filled("<div class=popisdetail>Plocha:<br>{size} m²<br>Stavba:<br>cihla</div>", size=k % 90 + 10)).otherwise("")
    html = F.concat(_filled("<H1 class=nadpisdetail>Byt ​{name}</H1>", name=F.col("s_name")), body, _filled(
        "Jméno:</td><td><span class=paction>{name}</span> Cena:</td><td colspan=2><br><b> {price} Kč</b> <a href='https://x/maps/place/{lat},14.25/@{lat},14.25,16z'>m</a> <a title=\"Přibližná lokalita\" rel=\"nofollow\">150 00</a>"
        " Vidělo:</td><td colspan=2><br> {views} lidí https://www.a.cz/img/{k}/12/1.jpg https://www.a.cz/img/{k}/12/1.jpg https://www.a.cz/img/9{k}/12/2.jpg", name=F.col("s_name"), price=F.floor(F.abs("s_acctbal")) + 1, lat=F.format_string("%.2f", 50 + (k % 100) / 100), views=k % 50, k=k))
    found = pages.detail(spread(t(spark, d, "supplier")).select("s_suppkey", html.alias("html")))
    return found.select("s_suppkey", "title", "price_minor", "currency", "seller_name", "lat", "lng", "zoom", "postcode", "views", F.size("photos").alias("n_photos"), "problem", F.try_element_at("block", F.lit("Plocha")).alias("plot"))


@query("SELECT p_partkey, p_size || ' m²; uvnitř' AS plot, p_type || '; Neznámé: x; Plocha:; again' AS building, NULL::VARCHAR AS energy FROM part")
def a09_label_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = _filled("{name}\nPlocha:\n{size} m²\n uvnitř \n\nStavba\n{kind}\nNeznámé: x\nPlocha:\nagain\n", name=F.col("p_name"), size=F.col("p_size"), kind=F.col("p_type"))
    block = pages.label_block(said)
    value = lambda label: F.try_element_at(block, F.lit(label))
    return spread(t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type")).select("p_partkey", value("Plocha").alias("plot"), value("Stavba").alias("building"), value("Energetická náročnost").alias("energy"))


def _adverts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    advert = _filled('«"id":"{id}","uri":"/a/{id}","price":{price},"currency":"{currency}","surface":{surface},"estateType":"BYT","gps":«"lat":{lat},"lng":{lng}»,"address(«\\"locale\\":\\"CS\\"»)":"{name}","disposition":"DISP_2_KK"»',
                     id=k % 200, price=F.format_string("%.2f", "c_acctbal"), currency=F.when(k % 3 == 0, "eur").otherwise(""), surface=k % 100 + 20, lat=k % 6 + 46, lng=F.lit(14.5), name=F.col("c_name"))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"apolloCache":{"Query":{"a":1},"Advert:1":'), advert, F.lit("}}}}</script>"))
    return pages.embedded_adverts(spread(t(spark, d, "customer")).select(k.alias("page_id"), html.alias("html"))).drop("html")


_ADVERTS = """adverts AS (SELECT c_custkey AS page_id, (c_custkey % 200)::VARCHAR AS external_id, '/a/' || c_custkey % 200 AS url, CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 100)::BIGINT END AS price_minor, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'EUR' ELSE 'CZK' END END AS currency,
    (c_custkey % 100 + 20)::DOUBLE AS area, 'byt' AS property_type, (c_custkey % 6 + 46)::DOUBLE AS lat, c_name AS address FROM customer)"""


@query(f"WITH {_ADVERTS} SELECT * FROM adverts")
def a10_adverts(spark: SparkSession, d: str) -> DataFrame:
    return _adverts(spark, d).select("page_id", "external_id", "url", "price_minor", "currency", F.col("area_sqm").cast("double").alias("area"), "property_type", "lat", "address")


@query(f"WITH {_ADVERTS} SELECT DISTINCT ON (external_id) external_id, page_id FROM adverts WHERE lat BETWEEN 48.5 AND 51.1 ORDER BY external_id, page_id")
def a11_admitted(spark: SparkSession, d: str) -> DataFrame:
    return pages.admitted(_adverts(spark, d)).select("external_id", "page_id")


@query("""SELECT o_orderkey AS k, o_orderkey::VARCHAR AS external_id, floor(o_totalprice)::BIGINT * 100 + 50 AS price_minor, 'CZK' AS currency, CASE WHEN o_orderkey % 40 > 0 THEN (o_orderkey % 40)::DOUBLE END AS area, 'Dlouhá, Praha' AS address, strftime(o_orderdate, '%Y-%m-%d') AS posted, 'Mail [REDACTED] now' AS description, 1 AS n_photos
    FROM orders WHERE o_orderkey > 0 AND o_orderkey % 5 > 0""")
def a12_offers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = _filled('«"success":{ok},"data":«"offers":[«"id":{k},"title":"Byt","area":{area},"rentalPrice":«"value":{price}.50»,"published":"{day}T08:00:00","street":«"title":"Dlouhá"»,"village":«"title":"Praha"»,"villagePart":«"name":"Praha"»,"description":"Mail a@b.cz now","photos":[«"path":"/p.jpg"»,«"path":""»]»]»»',
                   ok=F.when(k % 5 > 0, "true").otherwise("false"), k=k, area=k % 40, price=F.floor("o_totalprice"), day=F.date_format("o_orderdate", "yyyy-MM-dd"))
    found = pages.offers(t(spark, d, "orders").select(k.alias("k"), body.alias("body")))
    return found.select("k", "external_id", "price_minor", "currency", F.col("area_sqm").cast("double").alias("area"), "address", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "description", F.size("photos").alias("n_photos"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'good' ELSE '2' END AS condition, p_type AS kind, p_size::VARCHAR AS floor FROM part")
def a13_parameters(spark: SparkSession, d: str) -> DataFrame:
    page = _filled('«"condition":«"id":"{c}","text":"x"»,"kind":«"text":"{kind}"»,"floor":«"value":"{size}"»,"none":«»»', c=F.col("p_partkey") % 3, kind=F.col("p_type"), size=F.col("p_size"))
    held = pages.parameters(page, {"condition": {"0": "new", "1": "good"}})
    return t(spark, d, "part").select("p_partkey", *[F.try_element_at(held, F.lit(k)).alias(k) for k in ("condition", "kind", "floor")])


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'very_good' WHEN 1 THEN 'good' END AS condition, CASE p_partkey % 4 WHEN 0 THEN 'cihlova' WHEN 1 THEN 'jina' ELSE 'drevena' END AS material, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS lift, (p_size + 0.5)::DOUBLE AS area, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 7 END::INTEGER AS floor,
    CASE WHEN p_partkey % 6 < 5 THEN p_partkey % 6 + 1 END::INTEGER AS rooms, 1900 + p_partkey % 100 AS year_built, 'gas,wood' AS heating, 'Plyn, Dřevo' AS heating_label, p_type AS protection, (p_partkey % 3 = 2) AS lacks_condition FROM part""")
def a13_typed_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of detail pages as typed attributes, and a bag of the others."""
    k = F.col("p_partkey")
    page = _filled('«"buildingCondition":«"options":[{condition}]»,"material":«"options":[«"id":"{material}","title":"x"»]»,"lift":«"value":{lift}»,"usableArea":«"value":"{area},5 m²"»,"floorNumber":«"value":{floor}»,"roomCount":«"options":[«"id":"{rooms}"»]»,"yearBuilt":«"value":{year}»,"objectAge":«"value":30»,"heating":«"options":[«"id":"gas","title":"Plyn"»,«"id":"wood","title":"Dřevo"»]»,"protection":«"value":"{kind}"»,"none":«»,"gas":null»',
                   condition=F.when(k % 3 == 0, '{"id":"veryGood"}').when(k % 3 == 1, '{"id":"good","title":"Dobrý"}').otherwise('{"id":"a"},{"id":"b"}'), material=F.when(k % 4 == 0, "brick").when(k % 4 == 1, "mud").otherwise("wooden"), lift=F.when(k % 2 == 0, "true").otherwise('"Ne"'), area=F.col("p_size"), floor=k % 7,
                   rooms=F.element_at(F.array(*map(F.lit, [*pages.ROOM_COUNTS, "manyRooms"])), (k % 6 + 1).cast("int")), year=k % 100 + 1900, kind=F.col("p_type"))
    rows = pages.typed_parameters(t(spark, d, "part").select("p_partkey", page.alias("body")), "body")
    has, bag = (lambda a: F.try_element_at("attributes", F.lit(a))), (lambda a: F.try_element_at("unmapped", F.lit(a)))
    return rows.select(
        "p_partkey", has("condition").alias("condition"), has("building_material").alias("material"), has("has_elevator").alias("lift"), has("area_sqm").cast("double").alias("area"), has("floor").cast("int").alias("floor"), has("rooms").cast("int").alias("rooms"), has("year_built").cast("long").alias("year_built"),
        bag("heating").alias("heating"), bag("heating_label").alias("heating_label"), bag("protection").alias("protection"), (~F.map_contains_key("attributes", "condition")).alias("lacks_condition"))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A collection a region: the region, its nations as municipalities, and one nation without a name."""
    ring = "[[[0,0],[4,0],[4,4],[0,0]]]"
    one = lambda code, name, level, up: _filled('«"properties":«"external_code":"{code}","name":"{name}","level":"{level}","parent_code":"{up}"»,"geometry":«"type":"Polygon","coordinates":' + ring + '»»', code=code, name=name, level=F.lit(level), up=up)
    nations = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(one(F.concat(F.lit("N"), "n_nationkey"), F.when(F.col("n_nationkey") % 8 > 0, F.col("n_name")).otherwise(" "), "municipality", F.concat(F.lit("R"), "n_regionkey"))), ",").alias("list"))
    rows = t(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return feeds.features_of(rows.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), one(F.concat(F.lit("R"), "r_regionkey"), F.col("r_name"), "region", F.lit("")), F.lit(","), "list", F.lit("]}")).alias("body")), "cz", "census")


@query("""SELECT 'R' || r_regionkey AS external_code, r_name AS name, 'region' AS level, NULL AS parent_code, 4 AS corners, NULL AS error FROM region
    UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 8 > 0 THEN n_name END, CASE WHEN n_nationkey % 8 > 0 THEN 'municipality' END, CASE WHEN n_nationkey % 8 > 0 THEN 'R' || n_regionkey END, CASE WHEN n_nationkey % 8 > 0 THEN 4 END, CASE WHEN n_nationkey % 8 = 0 THEN 'no_name' END FROM nation""")
def a14_zone_features(spark: SparkSession, d: str) -> DataFrame:
    zones, errors = _features(spark, d)
    return zones.select("external_code", "name", "level", "parent_code", F.size(F.col("rings")[0]).alias("corners"), F.lit(None).cast("string").alias("error")).unionByName(errors.select("external_code", "error"), allowMissingColumns=True)


@query("SELECT 'N' || n_nationkey AS external_code, CASE WHEN n_regionkey > 0 THEN n_regionkey::BIGINT + 1 END AS parent_id, CASE WHEN n_regionkey = 0 THEN 'unresolved' END AS parent_problem FROM nation")
def a14_linked_zones(spark: SparkSession, d: str) -> DataFrame:
    nations = t(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.lit("CZ").alias("country"), F.lit("municipality").alias("level"), F.concat(F.lit("N"), "n_nationkey").alias("external_code"), F.concat(F.lit("R"), "n_regionkey").alias("parent_code"))
    regions = t(spark, d, "region").where("r_regionkey > 0").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit("CZ").alias("country"), F.lit("region").alias("level"), F.concat(F.lit("R"), "r_regionkey").alias("external_code"), F.lit(None).cast("string").alias("parent_code"))
    return feeds.linked_by_code(nations.unionByName(regions)).where("level = 'municipality'").select("external_code", "parent_id", "parent_problem")


_QUOTED = """said AS (SELECT s_suppkey, 'Z' || s_nationkey AS codzona, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'civili' END AS tipo, CASE WHEN s_suppkey % 2 = 0 THEN 'vendita' ELSE 'affitto' END AS contratto, s_suppkey % 50 AS lo, CASE WHEN s_suppkey % 13 = 0 THEN -1 ELSE s_suppkey % 50 + 5 END AS hi, CASE WHEN s_suppkey % 17 = 0 THEN '2025/3' ELSE '2025/2' END AS periodo, s_nationkey FROM supplier),
    judged AS (SELECT *, CASE WHEN s_nationkey >= 20 THEN 'unknown_zone' WHEN tipo = '' THEN 'no_type' WHEN periodo = '2025/3' THEN 'bad_period' WHEN hi < 0 THEN 'bad_price_max' END AS error FROM said)"""


@query(f"WITH {_QUOTED} SELECT CASE WHEN error IS NULL THEN s_nationkey::BIGINT END AS zone_id, CASE WHEN error IS NULL THEN CASE contratto WHEN 'vendita' THEN 'sale' ELSE 'rent' END END AS deal_type, CASE WHEN error IS NULL THEN lo * 100 END AS low, CASE WHEN error IS NULL THEN hi * 100 + 50 END AS high, CASE WHEN error IS NULL THEN '2025-07-01' END AS since, error FROM judged")
def a15_quotations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select(
        F.concat(F.lit(" Z"), "s_nationkey").alias("codzona"), F.when(k % 11 == 0, "").otherwise("civili").alias("tipo"), F.when(k % 2 == 0, "Vendita").otherwise("affitto").alias("contratto"),
        (k % 50).cast("string").alias("prezzo_min"), F.when(k % 13 == 0, "-1").otherwise(F.concat((k % 50 + 5).cast("string"), F.lit(",50"))).alias("prezzo_max"), F.when(k % 17 == 0, "2025/3").otherwise("2025/2").alias("periodo"))
    zones = t(spark, d, "nation").where("n_nationkey < 20").select(F.lit("IT").alias("country"), F.concat(F.lit("Z"), "n_nationkey").alias("external_code"), F.col("n_nationkey").cast("long").alias("id"))
    good, errors = feeds.quotations(rows, zones, "IT")
    return good.select("zone_id", "deal_type", F.col("price_min_minor").alias("low"), F.col("price_max_minor").alias("high"), F.date_format("period_start", "yyyy-MM-dd").alias("since"), F.lit(None).cast("string").alias("error")).unionByName(errors.select("error"), allowMissingColumns=True)


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, quote, round(o_totalprice / CASE quote WHEN 'CZK' THEN 10 ELSE 100 END)::DOUBLE AS rate FROM orders, (VALUES ('CZK'), ('USD')) q(quote) WHERE NOT (quote = 'USD' AND o_orderkey % 4 = 0)")
def a16_rates_xml(spark: SparkSession, d: str) -> DataFrame:
    """Rates in the central bank's XML; one without a number is skipped."""
    body = _filled("<gesmes:Envelope xmlns:gesmes='g' xmlns='e'><gesmes:subject>r</gesmes:subject><Cube><Cube time='{day}'><Cube currency='CZK' rate='{a}'/><Cube currency='USD' rate='{b}'/></Cube></Cube></gesmes:Envelope>",
                   day=F.date_format("o_orderdate", "yyyy-MM-dd"), a=F.round(F.col("o_totalprice") / 10).cast("long"), b=F.when(F.col("o_orderkey") % 4 > 0, F.round(F.col("o_totalprice") / 100).cast("long").cast("string")).otherwise("n/a"))
    return feeds.rates_in_xml(t(spark, d, "orders").select(body.alias("body"))).select(F.date_format("rate_date", "yyyy-MM-dd").alias("day"), "quote", F.col("rate").cast("double").alias("rate"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'CZK' AS quote, round(o_totalprice)::DOUBLE AS rate FROM orders WHERE o_orderkey % 6 > 0")
def a17_rates_json(spark: SparkSession, d: str) -> DataFrame:
    body = _filled('«"base":"{base}","rates":«"{day}":«"CZK":{rate},"USD":null»»»', base=F.when(F.col("o_orderkey") % 6 > 0, "EUR").otherwise("USD"), day=F.date_format("o_orderdate", "yyyy-MM-dd"), rate=F.round("o_totalprice").cast("long"))
    return feeds.daily_rates_json(t(spark, d, "orders").select(body.alias("body"))).select(F.date_format("rate_date", "yyyy-MM-dd").alias("day"), "quote", F.col("rate").cast("double").alias("rate"))


@query("""WITH asked AS (SELECT n_nationkey, 'http://h' || n_nationkey % 3 || '.cz/' || CASE n_nationkey % 4 WHEN 0 THEN 'private/a' WHEN 1 THEN 'private/open/b' WHEN 2 THEN 'x/file.pdf' ELSE '' END AS url FROM nation)
    SELECT url, CASE WHEN url LIKE 'http://h2%' THEN true WHEN url LIKE 'http://h1%' THEN NOT url LIKE '%.cz/private/open%' ELSE url LIKE '%/private/open/%' OR NOT (url LIKE '%/private/%' OR url LIKE '%.pdf') END AS allowed FROM (SELECT DISTINCT url FROM asked)""")
def a21_crawl_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Three sites: rules for all, rules that name the agent, and no file."""
    n = F.col("n_nationkey")
    files = t(spark, d, "nation").where("n_nationkey < 2").select(F.concat(F.lit("h"), n, F.lit(".cz")).alias("host"), F.when(n == 0, "User-agent: *\nDisallow: /private/\nAllow: /private/open/\nDisallow: /*.pdf$ # papers\n").otherwise("User-agent: *\nDisallow: /\n\nUser-agent: Bot\nUser-agent: other\nDisallow: /private/open\n").alias("text"))
    path = F.when(n % 4 == 0, "private/a").when(n % 4 == 1, "private/open/b").when(n % 4 == 2, "x/file.pdf").otherwise("")
    asked = t(spark, d, "nation").select(F.concat(F.lit("http://h"), n % 3, F.lit(".cz/"), path).alias("url")).distinct()
    return feeds.crawl_allowed(asked, feeds.crawl_rules(files), "bot").select("url", "allowed")


# B, C, D, E: list pages and tables ----------------------------------------------------------------------------------

_ZONES = """zones AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey::BIGINT + 1000 END AS parent_id FROM nation UNION ALL SELECT r_regionkey::BIGINT + 1000, r_name, NULL FROM region)"""


def _zones(spark: SparkSession, d: str) -> DataFrame:
    nations = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, (F.col("n_regionkey") + 1000).cast("long")).alias("parent_id"))
    return nations.unionByName(t(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id")))


def _photos(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").where("l_linenumber <= 3 and l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("object_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000).alias("ord"), F.concat(F.lit("p"), "l_linenumber", F.lit("_"), "l_partkey").alias("original_url"))


def _translations(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth object's text, every eighth's with a hash of an old text."""
    rows = t(spark, d, "orders").where("o_orderkey % 4 = 0").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("object_id"), F.explode(F.array(F.lit("ru"), F.lit("en"))).alias("lang"), F.sha2(F.when(F.col("o_orderkey") % 8 == 0, "old").otherwise(F.col("c_name")), 256).alias("source_hash"), F.col("o_orderpriority").alias("text")).where("lang = 'en' or object_id % 12 = 0")


_PHOTOS = "photos AS (SELECT l_orderkey AS object_id, l_linenumber * 100000 + l_partkey % 100000 AS ord, 'p' || l_linenumber || '_' || l_partkey AS original_url FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 3 = 0)"
_COVERS = "covers AS (SELECT object_id, min_by(original_url, ord) AS cover FROM photos GROUP BY 1)"


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL}, {market.HISTORY_SQL}, {_ZONES}, {_PHOTOS}, {_COVERS}, hazards AS (SELECT DISTINCT ON (object_id) l_orderkey AS object_id, l_tax AS h FROM lineitem ORDER BY object_id, l_shipdate DESC, l_linenumber DESC, l_tax DESC),
    points AS (SELECT object_id, arg_min(price_minor, (change_at, id)) AS p0, arg_max(price_minor, (change_at, id)) AS p1, count(*) AS n FROM history GROUP BY 1)
    SELECT o.id, z.name AS zone_name, u.name AS parent_name, l.price_deviation AS d, h.h AS hazard, p0 AS first_price, p1 AS last_price, CASE WHEN n >= 2 AND p1 < p0 THEN 'reduced' WHEN n >= 2 AND p1 > p0 THEN 'increased' END AS price_trend, cover,
        CASE WHEN o.id % 12 = 0 AND o.id % 8 > 0 THEN r.o_orderpriority END AS text_ru, CASE WHEN o.id % 4 = 0 AND o.id % 8 > 0 THEN r.o_orderpriority END AS text_en,
        {market.CLASS_SQL.replace(' d ', ' l.price_deviation ')} AS dev_class, CASE WHEN o.lat IS NOT NULL THEN 'point' ELSE 'area' END AS geom_kind
    FROM objects o JOIN orders r ON r.o_orderkey = o.id LEFT JOIN zones z ON z.id = o.zone_id LEFT JOIN zones u ON u.id = z.parent_id LEFT JOIN latest l ON l.object_id = o.id LEFT JOIN hazards h ON h.object_id = o.id LEFT JOIN points p ON p.object_id = o.id LEFT JOIN covers c ON c.object_id = o.id""")
def c01_wide_objects(spark: SparkSession, d: str) -> DataFrame:
    estimates = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("horizon_days"), F.col("l_shipdate").alias("computed_at")).agg(F.max("l_tax").alias("hazard_probability"))
    values = market.valuations(spark, d).groupBy("object_id", "id", "computed_at").agg(F.max("price_deviation").alias("price_deviation"))
    rows = catalog.wide_objects(market.objects(spark, d).withColumn("description_original", F.col("address")), _zones(spark, d), values, estimates, market.history(spark, d), _photos(spark, d), _translations(spark, d))
    return rows.select("id", "zone_name", "parent_name", F.col("price_deviation").alias("d"), F.col("hazard_probability").alias("hazard"), "first_price", "last_price", "price_trend", "cover", "text_ru", "text_en", "dev_class", "geom_kind")


@query(f"""WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL}, {_PHOTOS}, rows_ AS (SELECT o.*, l.price_deviation AS d FROM objects o LEFT JOIN latest l ON l.object_id = o.id)
    SELECT 'with_photo' AS what, count(*) AS total FROM rows_ WHERE status = 'active' AND current_price_minor >= 5000000 AND id IN (SELECT object_id FROM photos)
    UNION ALL SELECT 'without_photo', count(*) FROM rows_ WHERE rooms = 2 AND seller_type = 'agency' AND id NOT IN (SELECT object_id FROM photos)
    UNION ALL SELECT 'below', count(*) FROM rows_ WHERE d < -0.05 AND d > -0.15 AND lng BETWEEN 13 AND 16 AND lat BETWEEN 48.5 AND 50 AND area_sqm <= 100 AND contains(lower(address), 'customer#')""")
def b12_list_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of three list requests."""
    asked = {"with_photo": {"has_photo": "true", "status": "active", "price_min": "5000000"}, "without_photo": {"has_photo": "false", "rooms": "2", "seller_type": "agency"}, "below": {"dev_class": "below", "bbox": "13,48.5,16,50", "area_max": "100", "q": "Customer#"}}
    values = market.valuations(spark, d).groupBy("object_id", "id", "computed_at").agg(F.max("price_deviation").alias("price_deviation"))
    totals = [catalog.list_objects(market.objects(spark, d), values, _photos(spark, d), params)[1].select(F.lit(what).alias("what"), "total") for what, params in asked.items()]
    return totals[0].unionByName(totals[1]).unionByName(totals[2])


@query("""WITH low AS (SELECT DISTINCT l_orderkey AS o, 'k' || l_linenumber AS k FROM lineitem WHERE l_discount < 0.03), pairs AS (SELECT o_orderkey, k FROM orders, (VALUES ('k1'), ('k2'), ('k9')) v(k))
    SELECT o_orderkey, coalesce(string_agg(p.k, ',' ORDER BY p.k) FILTER (WHERE low.o IS NULL), '') AS kept FROM pairs p LEFT JOIN low ON low.o = o_orderkey AND low.k = p.k GROUP BY 1""")
def c15_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of which the provenance has low confidence are taken out."""
    things = t(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.expr("map('k1', 'a', 'k2', 'b', 'k9', 'c')").alias("attributes"))
    provenance = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.concat(F.lit("k"), "l_linenumber").alias("attr_key"), F.col("l_discount").alias("confidence"))
    return quality.without_low_confidence(things, provenance, 0.03).select(F.col("object_id").alias("o_orderkey"), F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("kept"))


@query(f"WITH {market.OBJECTS_SQL}, {market.VALUATIONS_SQL}, {market.LATEST_SQL} SELECT o.id, CASE WHEN o.id % 5 > 0 THEN l.price_deviation END AS d, o.id % 5 = 0 AS not_modeled FROM objects o LEFT JOIN latest l ON l.object_id = o.id")
def c19_not_modeled(spark: SparkSession, d: str) -> DataFrame:
    rows = market.objects(spark, d).withColumn("geo_confidence", F.when(F.col("id") % 5 > 0, "street"))
    values = market.valuations(spark, d).groupBy("object_id", "id", "computed_at").agg(F.max("price_deviation").alias("price_deviation"))
    return catalog.with_latest_valuation(rows, values).select("id", F.col("price_deviation").alias("d"), "not_modeled")


@query("""WITH base AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), changed AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'lease' ELSE 'rent' END AS deal, c_custkey % 30 AS lo FROM customer WHERE c_custkey % 5 = 0),
    good AS (SELECT * FROM changed WHERE deal = 'rent' AND lo <= 20)
    SELECT coalesce(b.id, g.id) AS id, CASE WHEN g.id IS NOT NULL THEN 'rent' ELSE 'sale' END AS deal_type, CASE WHEN b.id IS NOT NULL THEN '1998-01-01' ELSE '1999-06-01' END AS since, coalesce(b.id, g.id) % 7 > 0 AS active, NULL AS problem FROM base b FULL JOIN good g ON b.id = g.id
    UNION ALL SELECT id, deal, NULL, NULL, CASE WHEN deal = 'lease' THEN 'bad_deal_type' ELSE 'price_min_over_max' END FROM changed WHERE NOT (deal = 'rent' AND lo <= 20)""")
def c23_search_configs(spark: SparkSession, d: str) -> DataFrame:
    """Configurations after changes and after every seventh was taken out of use, and the changes that were turned down."""
    k, time = F.col("c_custkey"), lambda v: F.lit(v).cast("timestamp")
    blank = [F.lit(None).cast("double").alias("min_area_sqm"), F.lit(None).cast("double").alias("max_area_sqm"), F.lit("EUR").alias("currency")]
    base = t(spark, d, "customer").where("c_custkey % 2 = 0").select(k.alias("id"), F.lit("sale").alias("deal_type"), F.lit(0).cast("long").alias("min_price_minor"), F.lit(20).cast("long").alias("max_price_minor"), *blank, F.lit(True).alias("active"), time("1998-01-01").alias("created_at"), time("1998-01-01").alias("updated_at"))
    changes = t(spark, d, "customer").where("c_custkey % 5 = 0").select(k.alias("id"), F.when(k % 10 == 0, "lease").otherwise("rent").alias("deal_type"), (k % 30).alias("min_price_minor"), F.lit(20).cast("long").alias("max_price_minor"), *blank)
    after, rejected = configs.saved(base, changes, AS_OF)
    after = configs.retired(after, t(spark, d, "customer").where("c_custkey % 7 = 0").select(k.alias("id")), AS_OF)
    return after.select("id", "deal_type", F.date_format("created_at", "yyyy-MM-dd").alias("since"), "active", F.lit(None).cast("string").alias("problem")).unionByName(rejected.select("id", "deal_type", "problem"), allowMissingColumns=True)


_MODELS = "v AS (SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, CASE WHEN l_linenumber % 4 > 0 THEN l_discount END AS d, CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'no_zone: x' ELSE 'no_area' END END AS r, l_tax AS r2, l_partkey % 100 AS n, l_linenumber % 2 = 0 AS fb, 'v' || l_linenumber AS ver FROM lineitem ORDER BY l_orderkey, l_shipdate DESC, l_linenumber DESC, l_partkey DESC)"


@query(f"""WITH {market.OBJECTS_SQL}, {_MODELS}, joined AS (SELECT * FROM objects LEFT JOIN v ON id = k), reasons AS (SELECT country, deal_type, split_part(r, ':', 1) AS reason, count(*) AS c FROM joined WHERE d IS NULL AND r IS NOT NULL GROUP BY ALL),
    lead_ AS (SELECT DISTINCT ON (country, deal_type) country, deal_type, reason FROM reasons ORDER BY country, deal_type, c DESC, reason)
    SELECT j.country, j.deal_type, count(*) AS n, count(d) AS n_valued, max(r2) AS r_squared, max(n)::BIGINT AS sample_size, count(*) FILTER (WHERE fb) AS n_fallback, max(ver) AS model_version, any_value(reason) AS lead_reason FROM joined j LEFT JOIN lead_ USING (country, deal_type) GROUP BY 1, 2""")
def e04_model_states(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    one = t(spark, d, "lineitem").groupBy("l_orderkey", "l_shipdate", "l_linenumber").agg(F.max(F.struct("l_partkey", "l_discount", "l_tax")).alias("x")).select("l_orderkey", "l_shipdate", "l_linenumber", "x.*")
    values = one.select(F.col("l_orderkey").alias("object_id"), n.alias("id"), F.col("l_shipdate").alias("computed_at"), F.when(n % 4 > 0, F.col("l_discount")).alias("price_deviation"), F.when(n % 4 == 0, F.when(F.col("l_orderkey") % 3 == 0, "no_zone: x").otherwise("no_area")).alias("deviation_null_reason"),
                        F.col("l_tax").alias("r_squared"), (F.col("l_partkey") % 100).alias("sample_size"), (n % 2 == 0).alias("zone_fallback"), F.concat(F.lit("v"), n).alias("model_version"))
    return catalog.model_states(market.objects(spark, d), values)


@query("""WITH x AS (SELECT l_linenumber % 2 AS k, [1, l_quantity, l_linenumber]::DOUBLE[] AS x, l_partkey::DOUBLE AS y FROM lineitem), e AS (SELECT k, i, j, x[i] * x[j] AS v, x[i] * y AS r FROM x, range(1, 4) a(i), range(1, 4) b(j))
    SELECT k::INTEGER AS k, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, sum(v) AS xx, sum(r) AS xy FROM e GROUP BY ALL""")
def e31_gram_sums(spark: SparkSession, d: str) -> DataFrame:
    """The library's normal equations on whole numbers, where sums are exact."""
    import numpy as np

    rows = t(spark, d, "lineitem").select(F.array(F.lit(1.0), "l_quantity", F.col("l_linenumber").cast("double")).alias("x"), F.col("l_partkey").alias("y"), (F.col("l_linenumber") % 2).alias("k"))
    sums = gram.gram_sums(rows, 3, lambda x, y: (np.ones(len(y)), y, np.zeros(1)), "k")
    cells = [(k, i, j, float(a[i, j]), float(b[i])) for k, (a, b, _) in sums.items() for i in range(3) for j in range(3)]
    return spark.createDataFrame(cells, "k int, i int, j int, xx double, xy double")


@query("""WITH z AS (SELECT n_nationkey % 5 AS a, n_nationkey // 5 AS b, n_nationkey AS id FROM nation), o AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 60)::DOUBLE / 10 + 0.05 AS x, (s_suppkey * 3 % 50)::DOUBLE / 10 + 0.05 AS y, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS was, s_suppkey % 4 = 0 AS dirty FROM supplier),
    j AS (SELECT o.*, z.id AS now, (dirty OR was IS NULL) AS due FROM o LEFT JOIN z ON floor(x) = a AND floor(y) = b)
    SELECT id, CASE WHEN due THEN now ELSE was END::BIGINT AS zone_id, (dirty AND NOT due) AS zone_dirty FROM j""")
def b10_reassign(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are due get the zone (unit squares) that they lie in."""
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    corner = lambda dx, dy: F.struct((n % 5 + dx).cast("double").alias("x"), (F.floor(n / 5) + dy).cast("double").alias("y"))
    zones = t(spark, d, "nation").select(n.cast("long").alias("id"), F.lit("CZ").alias("country"), F.lit("zone").alias("level"), F.array(F.array(*[corner(*c) for c in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])).alias("rings"))
    things = t(spark, d, "supplier").select(k.alias("id"), F.lit("CZ").alias("country"), ((k * 7 % 60) / 10 + 0.05).alias("lng"), ((k * 3 % 50) / 10 + 0.05).alias("lat"), F.when(k % 3 > 0, F.col("s_nationkey").cast("long")).alias("zone_id"), (k % 4 == 0).alias("zone_dirty"), F.lit(False).alias("zone_terminal"))
    return spatial.reassign(things, zones, 1.0)[0].select("id", "zone_id", "zone_dirty")


@query("""WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS on_date, CASE o_orderkey % 2 WHEN 0 THEN 'CZK' ELSE 'USD' END AS quote FROM orders), r AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'CZK' ELSE 'USD' END AS quote, DATE '1995-01-01' + (s_suppkey * 37 % 1500)::INTEGER AS rate_date, max(s_suppkey)::DOUBLE AS rate FROM supplier GROUP BY 1, 2)
    SELECT o_orderkey, rate, strftime(rate_date, '%Y-%m-%d') AS rate_day, rate_date < on_date AS stale FROM a ASOF LEFT JOIN r ON a.quote = r.quote AND a.on_date >= r.rate_date""")
def l_fx_rate_for(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rates = t(spark, d, "supplier").groupBy(F.when(k % 2 == 0, "CZK").otherwise("USD").alias("quote"), F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 1500).cast("int")).alias("rate_date")).agg(F.max(k).cast("double").alias("rate")).withColumn("base", F.lit("EUR"))
    asked = t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("on_date"), F.when(F.col("o_orderkey") % 2 == 0, "CZK").otherwise("USD").alias("quote"))
    return asof.rate_for(asked, rates).select("o_orderkey", "rate", F.date_format("rate_date", "yyyy-MM-dd").alias("rate_day"), "stale")


# I: functions -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'Zlutoucky kun ' || p_name AS plain FROM part")
def i06_accents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", text.without_accents(F.concat(F.lit("Žluťoučký kůň "), "p_name")).alias("plain"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(make_date(year(o_orderdate), CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 7 END, 1), '%Y-%m-%d') END AS since FROM orders")
def i12_half_years(spark: SparkSession, d: str) -> DataFrame:
    half = F.when(F.month("o_orderdate") < 7, "1").otherwise("2")
    said = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "/").when(F.col("o_orderkey") % 3 == 1, "-S").otherwise("q"), half)
    return t(spark, d, "orders").select("o_orderkey", F.date_format(feeds.period_start(said), "yyyy-MM-dd").alias("since"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 3 THEN round(round(l_extendedprice * 100) / l_quantity)::BIGINT END AS per_area FROM lineitem")
def i13_price_per_area(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.price_per_area(market.cents("l_extendedprice"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).otherwise(0)).alias("per_area"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Lesní' WHEN 1 THEN 'Dlouhá ' || (s_suppkey % 90 + 1) WHEN 2 THEN 'Na Vršku ' || (s_suppkey % 90 + 1) || '/5' END AS street, 'Praha ' || (s_suppkey % 9 + 1) AS city, '1' || (s_suppkey % 9) || '0 00' AS postcode FROM supplier")
def i19_streets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    number, city = (k % 90 + 1).cast("string"), F.concat(F.lit("Praha "), (k % 9 + 1).cast("string"))
    said = F.when(k % 4 == 0, "byt v ulici Lesní, u parku").when(k % 4 == 1, F.concat(F.lit("na ulici Dlouhá "), number, F.lit(" v klidu"))).when(k % 4 == 2, F.concat(F.lit("ul. Na Vršku "), number, F.lit("/5, Ostrava"))).otherwise("pod kopcem")
    place = attributes.city_postcode(F.concat(city, F.lit(", 1"), (k % 9).cast("string"), F.lit("000")))
    return spread(t(spark, d, "supplier").select("s_suppkey")).select("s_suppkey", attributes.street(said, city).alias("street"), place["city"].alias("city"), place["postcode"].alias("postcode"))


@query("""SELECT p_partkey, (p_partkey % 8 + 1)::VARCHAR AS rooms, (p_partkey % 12 + 1)::VARCHAR AS floor, (p_partkey % 5 + 2)::VARCHAR AS floors, CASE p_partkey % 3 WHEN 0 THEN 'cihlova' WHEN 1 THEN 'panelova' ELSE 'drevena' END AS material, substr('ABCDEFG', (p_partkey % 7 + 1)::INTEGER, 1) AS energy,
    CASE WHEN p_partkey % 2 = 0 THEN 'osobni' ELSE 'druzstevni' END AS ownership, CASE WHEN p_partkey % 2 = 0 THEN 'very_good' ELSE 'renovated' END AS condition, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS elevator, (1900 + p_partkey % 120)::VARCHAR AS year_built, (p_size + 1000)::DOUBLE::VARCHAR AS monthly, (p_size + 10)::DOUBLE * 100 AS plot, 'rule_markup' AS method FROM part""")
def i21_attributes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    said = _filled("V {floor}. patře domu s {floors} podlažími, {material}, {lift}, {owner}, {state}. Třída {energy}. Dům byl postaven v roce {year}? Poplatky {monthly} Kč/měsíc. Pozemek o výměře {plot} ar.", floor=k % 12 + 1, floors=k % 5 + 2, material=F.when(k % 3 == 0, "cihlový").when(k % 3 == 1, "panelák").otherwise("dřevostavba"),
                   lift=F.when(k % 2 == 0, "s výtahem").otherwise("bez výtahu"), owner=F.when(k % 2 == 0, "v osobním vlastnictví").otherwise("družstevní"), state=F.when(k % 2 == 0, "velmi dobrý stav").otherwise("po rekonstrukci"), energy=F.substring(F.lit("ABCDEFG"), (k % 7 + 1).cast("int"), F.lit(1)), year=k % 120 + 1900, monthly=F.col("p_size") + 1000, plot=F.col("p_size") + 10)
    said = F.regexp_replace(said, "Dům byl postaven", "Postaven")
    rows = spread(t(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.concat(F.lit("Byt "), (k % 8 + 1).cast("string"), F.lit("+kk")).alias("title"), said.alias("text"), F.expr("cast(map() as map<string,string>)").alias("block"))
    found = attributes.derive(attributes.Listing(F.col("title"), F.col("text"), F.col("block")))
    names = ["rooms", "floor", "floors", "material", "energy", "ownership", "condition", "elevator", "year_built", "monthly"]
    return rows.select("p_partkey", *[found[n]["value"].alias(n) for n in names], found["plot_area"]["value"].cast("double").alias("plot"), found["rooms"]["method"].alias("method"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'too_short' WHEN 1 THEN 'has_digit' WHEN 2 THEN 'not_in_quote' WHEN 3 THEN 'not_in_text' END AS guard FROM part")
def i24_mine_guard(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    pattern = F.when(k % 5 == 0, "x").when(k % 5 == 1, "a1").when(k % 5 == 2, "elsewhere").otherwise(F.upper(name))
    quote = F.concat(F.lit("very "), name)
    return t(spark, d, "part").select("p_partkey", text.mine_guard(pattern, quote, F.when(k % 5 == 3, "nothing").otherwise(F.concat(F.lit("a  VERY "), name))).alias("guard"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'alive' WHEN 3 THEN 'relisted' WHEN 4 THEN 'unknown' END AS verdict, n_nationkey::VARCHAR AS listing FROM nation")
def i40_url_verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    path = F.concat(F.lit("/inzerat/"), n.cast("string"), F.lit("/x"))
    asked, case = F.concat(F.lit("https://a.cz"), path), n % 6
    status = F.when(case == 0, 404).when(case == 1, 301).when(case == 5, 503).otherwise(200)
    reached = F.when(case == 3, "https://a.cz/inzerat/999/y").otherwise(asked)
    body = F.when(case.isin(2, 3), '<H1 class="nadpisdetail">x').when(case == 4, "<title>Byty - inzerce</title>").otherwise("")
    return t(spark, d, "nation").select("n_nationkey", urls.url_verdict(status, asked, reached, F.when(case == 1, "https://a.cz/inzeraty/"), body).alias("verdict"), urls.listing_id(path).alias("listing"))


@query("SELECT s_suppkey, (s_suppkey % 20) >= 10 AND 100.0 * (s_suppkey % 7 + 1) > 25 * (s_suppkey % 20) AS stop, CASE WHEN s_suppkey % 5 = 0 THEN 'unverifiable' WHEN 2 * (s_suppkey % 4) >= s_suppkey % 5 THEN 'healthy' ELSE 'broken' END AS controls FROM supplier")
def i41_delist_guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select("s_suppkey", scheduling.delist_guard(k % 7, k % 20, 25, 10).alias("stop"), scheduling.controls_verdict(k % 5, k % 4).alias("controls"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN array_to_string(list_filter(['object_id', 'price', 'url'], lambda x: x <> 'object_id' AND (x = 'url' OR n_nationkey % 2 = 0)), ',') END AS lacks FROM (SELECT n_nationkey FROM nation)")
def i50_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    payload = F.create_map(F.lit("object_id"), n.cast("string"), F.lit("price"), F.when(n % 2 == 0, "").otherwise("5"))
    return t(spark, d, "nation").select("n_nationkey", F.array_join(configs.missing_keys(F.when(n % 3 < 2, "new_listing").otherwise("other"), payload), ",").alias("lacks"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey::BIGINT WHEN 1 THEN 30 END AS wait FROM nation")
def i51_retry_seconds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    header = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, "Tue, 01 Jun 1999 00:00:30 GMT").otherwise("soon")
    return t(spark, d, "nation").select("n_nationkey", probing.retry_seconds(header, F.lit(AS_OF)).alias("wait"))


# K, M: upkeep -------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey AS src, o_orderpriority AS o, o_orderkey % 4 AS c FROM orders) SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 10 = 3 AND o_orderkey % 20 = 3 THEN 'delisted' WHEN o_orderstatus = 'F' AND NOT o_orderkey % 6 = 0 THEN 'delisted' ELSE 'active' END AS status,
    CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 20 = 3 THEN 'unknown' WHEN o_orderstatus = 'F' AND NOT o_orderkey % 6 = 0 THEN 'withdrawn_by_owner' END AS reason FROM orders""")
def k03_delist_pass(spark: SparkSession, d: str) -> DataFrame:
    """Objects missed twice go if asking for them says so (not if they are alive), and those seen again come back."""
    k = F.col("o_orderkey")
    gone = F.col("o_orderstatus") == "F"
    things = t(spark, d, "orders").select(k.alias("id"), F.when(gone, "delisted").otherwise("active").alias("status"), F.when(gone, "withdrawn_by_owner").alias("delisted_reason"))
    missed = t(spark, d, "orders").select(k.alias("object_id"), F.when(k % 10 == 3, 2).otherwise(k % 2).alias("misses"))
    verdicts = t(spark, d, "orders").where("o_orderkey % 10 = 3").select(k.alias("object_id"), F.when(k % 20 == 3, "unknown").otherwise("alive").alias("verdict"))
    after, _ = delisting.delist_pass(things, missed, verdicts=verdicts)
    return delisting.reactivate(after, t(spark, d, "orders").where("o_orderkey % 6 = 0").select(k.alias("object_id"))).select("id", "status", F.col("delisted_reason").alias("reason"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 0) AS candidates, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, true AS anomaly, count(*) FILTER (WHERE o_orderstatus = 'F') AS delisted FROM orders")
def k11_delist_guard(spark: SparkSession, d: str) -> DataFrame:
    """Half of the objects missing at once is a broken run: nothing changes."""
    k = F.col("o_orderkey")
    things = t(spark, d, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "delisted").otherwise("active").alias("status"), F.lit(None).cast("string").alias("delisted_reason"))
    after, report = delisting.delist_pass(things, t(spark, d, "orders").select(k.alias("object_id"), F.when(k % 2 == 0, 5).otherwise(0).alias("misses")))
    return report.select("candidates", "active", "anomaly", after.where("status = 'delisted'").agg(F.count("*")).scalar().alias("delisted"))


@query("""SELECT c_name AS domain, (c_custkey % 50 = 0) AS pinned FROM customer WHERE c_custkey % 4 <> 1 AND (c_custkey % 3 = 0 OR c_custkey % 120 >= 60)""")
def k13_due_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    probed = F.when(k % 3 > 0, F.lit(AS_OF) - F.make_dt_interval(mins=(k % 120).cast("int")))
    rows = t(spark, d, "customer").select(F.col("c_name").alias("domain"), F.when(k % 4 == 1, "direct").otherwise("pending").alias("class"), probed.alias("probed_at"), (k % 50 == 0).alias("pinned"))
    return queues.due_candidates(rows, AS_OF).select("domain", "pinned")


@query("""WITH rows_ AS (SELECT 'T' || s_nationkey AS id, s_suppkey AS object_id, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status, s_suppkey % 4 > 0 AS same, s_suppkey % 5 > 0 AS judged FROM supplier), after AS (SELECT *, CASE WHEN status = 'pending' AND judged THEN CASE WHEN same THEN 'done' ELSE 'mismatch' END ELSE status END AS now FROM rows_)
    SELECT 'T' || n_nationkey AS id, CASE WHEN count(*) FILTER (WHERE now = 'mismatch') > 0 THEN 'demoted' ELSE 'active' END AS status, count(*) FILTER (WHERE now = 'mismatch') AS mismatches, count(*) FILTER (WHERE now = 'pending') AS pending FROM nation LEFT JOIN after ON id = 'T' || n_nationkey GROUP BY n_nationkey""")
def k09_settled_shadow(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the language model contradicts are demoted."""
    k = F.col("s_suppkey")
    templates = t(spark, d, "nation").select(F.concat(F.lit("T"), "n_nationkey").alias("id"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("shadow_mismatches"))
    key = [F.concat(F.lit("T"), "s_nationkey").alias("template_id"), k.alias("object_id"), F.lit("a").alias("attr_key")]
    checks = t(spark, d, "supplier").select(*key, F.lit("x").alias("template_value"), F.when(k % 3 == 0, "done").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("llm_value"))
    verdicts = t(spark, d, "supplier").where("s_suppkey % 5 > 0").select(*key, F.when(k % 4 > 0, "x").otherwise("y").alias("llm_value"))
    fell, after = rules.settle_shadow(templates, checks, verdicts)
    open_ = after.groupBy(F.col("template_id").alias("id")).agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return fell.join(open_, "id", "left").select("id", "status", F.col("shadow_mismatches").alias("mismatches"), F.coalesce("pending", F.lit(0)).alias("pending"))


@query("""SELECT o_custkey AS source_id, dayofweek(o_orderdate) || '-' || hour(o_orderdate) AS slot_key, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS scans, sum(o_orderkey % 9)::BIGINT AS new_objects FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL""")
def k05_slot_yields(spark: SparkSession, d: str) -> DataFrame:
    """Yields per slot: only complete runs count."""
    k = F.col("o_orderkey")
    runs = t(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.when(k % 3 > 0, "complete").otherwise("partial").alias("completeness"), (k % 9).alias("new_objects"))
    return crawl.slot_yields(runs).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'delisted' ELSE 'active' END AS status, o_orderkey % 7 = 0 AS lost FROM orders), a AS (SELECT * FROM o WHERE status = 'active')
    SELECT 'corpus' AS name, 'INFO' AS status, 'active=' || (SELECT count(*) FROM a) || ', corpus=' || (SELECT count(*) FROM a) || ', delisted=' || (SELECT count(*) FROM o WHERE status = 'delisted') AS detail
    UNION ALL SELECT 'mirrors:area_sqm', CASE WHEN count(*) FILTER (WHERE id % 5 = 0) = 0 THEN 'OK' ELSE 'FAIL' END, '0/0/' || count(*) FILTER (WHERE id % 5 = 0) FROM a
    UNION ALL SELECT 'not_modeled', CASE WHEN count(*) FILTER (WHERE id % 60 = 0) <= 0.02 * count(*) THEN 'OK' ELSE 'FAIL' END, count(*) FILTER (WHERE id % 60 = 0) || '/' || count(*) FROM a
    UNION ALL SELECT 'lost', CASE WHEN count(*) = 0 THEN 'OK' ELSE 'FAIL' END, count(*) || ' without a detail page for over 24 h' FROM a WHERE lost
    UNION ALL SELECT 'schedule:' || n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'INFO' WHEN n_nationkey % 4 = 1 AND n_nationkey % 2 = 1 THEN 'OK' ELSE 'FAIL' END, 'state=' || CASE WHEN n_nationkey % 4 = 0 THEN 'blocked' ELSE 'active' END || ', configs=' || CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 0 END FROM nation
    UNION ALL SELECT 'blocked:' || n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'FAIL' ELSE 'OK' END, 'state=' || CASE WHEN n_nationkey % 4 = 0 THEN 'blocked' ELSE 'active' END FROM nation
    UNION ALL SELECT 'valuations', 'FAIL', count(*) || ' rows, ' || count(*) FILTER (WHERE l_linenumber = 3) || ' without value and reason' FROM lineitem""")
def m_doctor(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of tables made from the test tables."""
    k, n, day = F.col("o_orderkey"), F.col("n_nationkey"), F.lit(AS_OF)
    area = (k % 90 + 10).cast("decimal(10,2)")
    things = t(spark, d, "orders").select(k.alias("id"), F.lit("CZ").alias("country"), F.lit("CZ").alias("property_country"), F.when(F.col("o_orderstatus") == "F", "delisted").otherwise("active").alias("status"), area.alias("area_sqm"), F.lit(None).cast("int").alias("rooms"), F.lit(None).cast("string").alias("seller_type"),
                                          F.create_map(F.lit("area_sqm"), F.when(k % 5 == 0, "1").otherwise(area.cast("string"))).alias("attributes"), F.when(k % 60 > 0, "street").alias("geo_confidence"), F.when(k % 7 > 0, day).alias("detail_fetched_at"), (day - F.expr("INTERVAL 48 HOURS")).alias("first_seen_at"))
    sources = t(spark, d, "nation").select(F.col("n_name").alias("source_id"), F.when(n % 4 == 0, "blocked").otherwise("active").alias("state"))
    searches = t(spark, d, "nation").where("n_nationkey % 4 = 1").select(F.col("n_name").alias("source_id"), F.lit(True).alias("active"))
    runs = t(spark, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_name").alias("source_id"), (day - F.expr("INTERVAL 1 HOUR")).alias("started_at"))
    queue = t(spark, d, "nation").select(F.lit("sent").alias("status"), day.alias("created_at"))
    values = t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") > 4, F.col("l_discount")).alias("price_deviation"), F.when(~F.col("l_linenumber").isin(3, 5, 6, 7), "no_area").alias("deviation_null_reason"))
    found = quality.invariants(things, sources, searches, runs, queue, values, AS_OF)
    return found.where("name not in ('mirrors:rooms', 'mirrors:seller_type', 'notifs')")


# J: model runs ------------------------------------------------------------------------------------------------------


@query(f"""WITH {market.OBJECTS_SQL} SELECT id AS object_id, CASE WHEN current_price_minor IS NULL OR current_price_minor <= 0 THEN 'no_price' WHEN id % 31 = 0 THEN 'no_currency' WHEN id % 37 = 0 THEN 'currency_mismatch' WHEN area_sqm IS NULL OR area_sqm <= 0 THEN 'no_area' WHEN id % 41 = 0 THEN 'no_zone' WHEN id % 43 = 0 THEN 'no_type' END AS reason,
    NOT (current_price_minor IS NULL OR current_price_minor <= 0 OR id % 31 = 0 OR id % 37 = 0 OR area_sqm IS NULL OR area_sqm <= 0 OR id % 41 = 0 OR id % 43 = 0) AS valued FROM objects WHERE status = 'active'""")
def j07_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every active object has a value or the first reason for having none."""
    from hearthline.operators import hedonic

    k = F.col("id")
    rows = market.objects(spark, d).select(
        k.alias("object_id"), "status", F.col("current_price_minor").alias("price_minor"), F.when(k % 31 > 0, F.when(k % 37 == 0, "CZK").otherwise("EUR")).alias("currency"), "area_sqm", F.when(k % 41 > 0, F.col("zone_id")).alias("zone_id"), F.when(k % 43 > 0, "flat").alias("property_type"),
        F.create_map(F.lit("rooms"), F.col("rooms").cast("string")).alias("attrs"), F.month("first_seen_at").alias("month"), F.when(F.col("lng").isNotNull(), "street").otherwise("zone").alias("geo_level"))
    parents = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    _, valuations, _ = hedonic.valuation_run(rows, [hedonic.Attribute("rooms")], parents, "EUR")
    return valuations.select("object_id", F.col("null_reason").alias("reason"), F.col("price_deviation").isNotNull().alias("valued"))


@query("""WITH h AS (SELECT o_custkey % 50 AS country, o_orderpriority AS deal_type, o_orderdate AS computed_at, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'uncalibrated' ELSE 'insufficient_history' END AS status FROM orders),
    l AS (SELECT *, lag(status) OVER (PARTITION BY country, deal_type ORDER BY computed_at, o_orderkey) AS before FROM h)
    SELECT country, deal_type, strftime(computed_at, '%Y-%m-%d') AS day, o_orderkey AS model_version, before, status FROM l WHERE CASE WHEN before IS NULL THEN status = 'published' ELSE status <> before END""")
def j13_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Notices of models whose status changed from run to run."""
    from hearthline.operators import survival

    k = F.col("o_orderkey")
    history = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("country"), F.col("o_orderpriority").alias("deal_type"), F.col("o_orderdate").alias("computed_at"), k.alias("model_version"), F.when(k % 3 == 0, "published").when(k % 3 == 1, "uncalibrated").otherwise("insufficient_history").alias("status"))
    return survival.transitions(history).select("country", "deal_type", F.date_format("computed_at", "yyyy-MM-dd").alias("day"), "model_version", "before", "status")
