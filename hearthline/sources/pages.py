"""Listings out of fetched pages: category cards, detail pages, JSON embedded in a page, JSON answers of an API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import html_text, join_unique, redact, when_found, without_accents

#: What stands in place of a price that isn't published, and the labels of a description's block.
NO_PRICE = ["V textu", "Dohodou", "Nabídněte", "Zdarma", "Nerozhoduje"]
LABELS = ["Plocha", "Stavba", "Energetická náročnost", "Vlastnictví", "Infrastruktura", "Lokalita", "Příslušenství", "Ostatní", "Celková cena"]
#: What invisible characters pages hold, and the markup of a card and a detail page.
ZERO_WIDTH = "​‌‍﻿"
CARD = '<div class="inzeraty inzeratyflex">'
COUNTER = r"inzerát[^<>]*? z\s*([\d\s ]+)"
EMBEDDED = r'(?s)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>'
PRICE = r"Cena:</td><td colspan=2><br><b>(?:<span[^>]*>)?\s*([\d][\d\s]*)\s*(Kč|CZK|€|EUR)"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s ]", "").try_cast("long")


def result_count(html: Column) -> Column:
    """The number of results that a page's counter states."""
    return digits(when_found(html, COUNTER))


def page_numbers(total: Column, size: int = 20) -> Column:
    """1, 2, ... up to the page that holds the last result."""
    return F.sequence(F.lit(1), F.greatest(F.ceil(total / size), F.lit(1)).cast("int"))


def cards(pages: DataFrame, html: str = "html", marker: str = CARD, base: str = "") -> DataFrame:
    """pages with external_id, url, posted_at, price_minor, currency, address, description, problem: a row per card.

    A price div with a number is that price in hundredths; one of the known phrases is no price; anything else is a problem, as the layout may have changed.
    """
    parts = F.split(html, rf"\Q{marker}\E")
    split = pages.select("*", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("card_no", "card"))
    card = F.col("card")
    link = r'href="?(/inzerat/(\d+)/[^"\s>]*)'
    price_div = when_found(card, r'(?s)(<div class="?inzeratycena"?>.*?</div>)')
    number = digits(when_found(price_div, r"(\d[\d\s ]*)\s*Kč"))
    said = F.trim(F.regexp_replace(F.regexp_replace(price_div, "<[^>]*>", " "), r"\s+", " "))
    day = r"\[(\d{1,2})\.(\d{1,2})\. (\d{4})\]"
    posted = F.try_make_timestamp(when_found(card, day, 3).cast("int"), when_found(card, day, 2).cast("int"), when_found(card, day, 1).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    place = html_text(F.regexp_replace(when_found(card, r'(?s)<div class="?inzeratylok"?>(.*?)</div>'), r"(?i)<br\s*/?>", ", "))
    text = F.trim(F.regexp_replace(html_text(F.regexp_replace(when_found(card, r'(?s)<div class="?popis"?>(.*?)</div>'), "<[^>]*>", " ")), r"\s+", " "))
    problem = (F.when(~card.rlike(link), "no_link").when(card.rlike(day) & posted.isNull(), "bad_date").when(price_div.isNull(), "no_price_div")
               .when(number.isNull() & ~said.isin(NO_PRICE), F.concat(F.lit("unknown_price: "), said)))
    return split.select(*pages.columns, "card_no", when_found(card, link, 2).alias("external_id"), F.concat(F.lit(base), when_found(card, link, 1)).alias("url"), posted.alias("posted_at"),
                        (number * 100).alias("price_minor"), F.when(number.isNotNull(), "CZK").alias("currency"), F.nullif(place, F.lit("")).alias("address"), F.nullif(text, F.lit("")).alias("description"), problem.alias("problem"))


def completeness(problems: Column, failed_pages: Column, expected_pages: Column) -> Column:
    """complete, partial (a page or card wasn't read) or failed (no page was)."""
    return F.when(failed_pages >= expected_pages, "failed").when((failed_pages > 0) | (problems > 0), "partial").otherwise("complete")


def label_block(text: Column, labels: list[str] = LABELS) -> Column:
    """map of label to what its lines hold, joined by "; ". A label is a line of its own, with or without a colon; its first place counts."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    keys = F.transform(lines, lambda x: F.lower(F.regexp_replace(x, ":$", "")))
    known = [label.lower() for label in labels]
    label_of = F.create_map(*[v for label in labels for v in (F.lit(label.lower()), F.lit(label))])
    is_start = lambda i: F.element_at(keys, i).isin(known) & (F.array_position(keys, F.element_at(keys, i)) == i)
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), is_start)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines) + 1))
    value = lambda a, b: F.array_join(F.filter(F.slice(lines, a + 1, F.greatest(b - a - 1, F.lit(0))), lambda x: x != ""), "; ")
    entries = F.zip_with(starts, ends, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.try_element_at(label_of, F.element_at(keys, a)).alias("k"), value(a, b).alias("v"))))
    held = F.filter(entries, lambda e: e.isNotNull() & (e["v"] != ""))
    return F.map_from_entries(F.when(F.size(starts) > 0, held).otherwise(F.expr("cast(array() as array<struct<k:string,v:string>>)")))


def detail(pages: DataFrame, html: str = "html", photo: str = r"(https://[\w.]+/img/(\d+)/\d+/\d+\.jpg[^\s\"']*)") -> DataFrame:
    """pages with title, description, block, price_minor, currency, seller_name, lat, lng, zoom, postcode, views, photos, problem of a detail page."""
    source = F.translate(html, ZERO_WIDTH, "")
    title = F.trim(F.regexp_replace(html_text(when_found(source, r'(?s)<H1 class="?nadpisdetail"?>(.*?)</H1>')), r"\s+", " "))
    text = html_text(F.regexp_replace(when_found(source, r'(?s)<div class="?popisdetail"?>(.*?)(?:</div>|\z)'), r"(?i)<(?!br)[^>]*>", " "))
    sign = when_found(source, PRICE, 2)
    where = r"maps/place/(-?\d+\.\d+),(-?\d+\.\d+)/@-?\d+\.\d+,-?\d+\.\d+,(\d+)z"
    whole, number = F.regexp_extract_all(source, F.lit(photo), 1), F.regexp_extract_all(source, F.lit(photo), 2)
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(number), F.lit(1))), lambda i: F.array_position(number, F.try_element_at(number, i)) == i)
    problem = F.when(title.isNull() | (title == ""), "no_title").when(text.isNull() | (text == ""), "no_description")
    return pages.select(
        "*", title.alias("title"), text.alias("description"), (digits(when_found(source, PRICE)) * 100).alias("price_minor"), F.when(sign.isin("€", "EUR"), "EUR").when(sign.isNotNull(), "CZK").alias("currency"),
        html_text(F.trim(when_found(F.regexp_extract(source, r"(?s)Jméno:(.*)", 1), r'class="?paction"?>([^<]*)</span>'))).alias("seller_name"),
        when_found(source, where, 1).cast("double").alias("lat"), when_found(source, where, 2).cast("double").alias("lng"), when_found(source, where, 3).cast("int").alias("zoom"),
        F.trim(when_found(source, r'title="Přibližná lokalita" rel="nofollow">([^<]+)</a>')).alias("postcode"), when_found(source, r"Vidělo:</td><td colspan=2><br>\s*(\d+)\s*lidí").cast("int").alias("views"),
        F.transform(F.filter(firsts, lambda i: i <= F.size(whole)), lambda i: F.element_at(whole, i)).alias("photos"), problem.alias("problem")).withColumn("block", label_block(F.coalesce("description", F.lit(""))))


def minor_of(major: Column) -> Column:
    """Exact hundredths of a decimal string; null unless positive."""
    amount = major.try_cast("decimal(20,4)")
    return F.when(amount > 0, F.floor(amount * 100).cast("long"))


def embedded_adverts(pages: DataFrame, html: str = "html", prefix: str = "Advert:", base: str = "") -> DataFrame:
    """pages with external_id, url, price_minor, currency, area_sqm, property_type, lat, lng, address, disposition: a row per advert in the cache that a page embeds as JSON."""
    cache = F.from_json(F.get_json_object(F.regexp_extract(html, EMBEDDED, 1), "$.props.pageProps.apolloCache"), "map<string,string>")
    rows = pages.select("*", F.explode(F.map_filter(cache, lambda k, _: k.startswith(prefix))).alias("key", "advert"))
    field = lambda name: F.get_json_object("advert", f"$.{name}")
    address = F.try_element_at(F.map_values(F.map_filter(F.from_json("advert", "map<string,string>"), lambda k, v: k.startswith("address") & v.isNotNull())), F.lit(1))
    price = minor_of(field("price"))
    return rows.where(field("id").isNotNull() & field("uri").isNotNull()).select(
        *pages.columns, field("id").alias("external_id"), F.concat(F.lit(base), field("uri")).alias("url"), price.alias("price_minor"), F.when(price.isNotNull(), F.upper(F.coalesce(F.nullif(field("currency"), F.lit("")), F.lit("CZK")))).alias("currency"),
        field("surface").try_cast("decimal(10,2)").alias("area_sqm"), F.lower(field("estateType")).alias("property_type"), field("gps.lat").try_cast("double").alias("lat"), field("gps.lng").try_cast("double").alias("lng"),
        address.alias("address"), field("disposition").alias("disposition"))


#: The country's box of positions that are let in.
COUNTRY_BOX = (12.0, 48.5, 19.0, 51.1)


def admitted(listings: DataFrame, key: str = "external_id", order: str = "page_id") -> DataFrame:
    """Listings with a position in the country's box; of repeats across pages the first."""
    from hearthline.functions.geo import in_box
    from hearthline.operators.latest import top_per_key

    inside = listings.where(in_box(F.col("lng"), F.col("lat"), COUNTRY_BOX))
    return top_per_key(inside, [key], [F.asc(order)])


_NAMED = "struct<title:string,name:string>"
OFFERS = (f"struct<success:boolean,error:string,extraData:struct<total:int,totalPages:int,perPage:int,currentPage:int>,data:struct<offers:array<struct<id:long,title:string,area:decimal(12,2),disposition:string,"
          f"geoCoordinates:struct<lat:double,lng:double>,rentalPrice:struct<value:decimal(18,4),currency:string>,absoluteUrl:string,offerType:string,propertyType:string,published:string,"
          f"street:{_NAMED},village:{_NAMED},villagePart:{_NAMED},description:string,photos:array<struct<path:string,url:string>>>>>>")


def offers(answers: DataFrame, body: str = "body") -> DataFrame:
    """answers with the offers of a find request: a row each; an answer without success has none."""
    parsed = answers.withColumn("__r", F.from_json(body, OFFERS)).where("__r.success")
    rows = parsed.select(*answers.columns, F.explode("__r.data.offers").alias("o")).where("o.id <> 0")
    name = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}.title"), F.lit("")), F.col(f"o.{c}.name"))
    price = minor_of(F.col("o.rentalPrice.value"))
    posted = F.coalesce(F.try_to_timestamp(F.col("o.published")), F.try_to_timestamp(F.col("o.published"), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return rows.select(
        *answers.columns, F.col("o.id").cast("string").alias("external_id"), F.col("o.absoluteUrl").alias("url"), F.col("o.title").alias("title"), price.alias("price_minor"),
        F.when(price.isNotNull(), F.upper(F.coalesce(F.nullif(F.col("o.rentalPrice.currency"), F.lit("")), F.lit("CZK")))).alias("currency"), F.when(F.col("o.area") > 0, F.col("o.area")).alias("area_sqm"),
        F.nullif(F.col("o.propertyType"), F.lit("")).alias("property_type"), F.col("o.geoCoordinates.lat").alias("lat"), F.col("o.geoCoordinates.lng").alias("lng"), F.nullif(join_unique([name("street"), name("villagePart"), name("village")]), F.lit("")).alias("address"),
        posted.alias("posted_at"), F.col("o.disposition").alias("disposition"), F.col("o.offerType").alias("offer_type"), redact(F.nullif(F.col("o.description"), F.lit(""))).alias("description"),
        F.filter(F.transform("o.photos", lambda p: F.coalesce(F.nullif(p["path"], F.lit("")), p["url"])), lambda u: u.isNotNull() & (u != "")).alias("photos"))


def parameters(page_json: Column, codes: dict[str, dict[str, str]]) -> Column:
    """map of a detail page's parameter dictionary: ids go through the given code tables (an unknown id stays), else the text stays."""
    held = F.from_json(page_json, "map<string,struct<id:string,text:string,value:string>>")
    out = F.transform_values(held, lambda k, v: F.coalesce(F.nullif(v["id"], F.lit("")), F.nullif(v["text"], F.lit("")), v["value"]))
    named = F.create_map(*[x for key, table in codes.items() for code, name in table.items() for x in (F.lit(f"{key}\0{code}"), F.lit(name))])
    if codes:
        out = F.transform_values(out, lambda k, v: F.coalesce(F.try_element_at(named, F.concat(k, F.lit("\0"), v)), v))
    return F.map_filter(out, lambda _, v: v.isNotNull())


def yes(value: Column) -> Column:
    return without_accents(F.lower(value)).isin("ano", "yes", "true", "1")


#: The source's names of parameters, the attribute each gives, and how it is read; codes that are called otherwise here; names of room counts.
TYPED = [("energyEfficiencyRating", "energy_class", "letter"), ("buildingCondition", "condition", "code"), ("material", "building_material", "code"), ("ownership", "ownership_type", "code"), ("gas", "has_gas", "yes"), ("lift", "has_elevator", "yes"),
         ("usableArea", "area_sqm", "area"), ("estateArea", "plot_area", "area"), ("floors", "floors", "count"), ("floorNumber", "floor", "count"), ("roomCount", "rooms", "rooms"), ("propertyType", "property_type", "code"), ("objectAge", "year_built", "year"), ("yearBuilt", "year_built", "year")]
CODES = {"condition": {"veryGood": "very_good"}, "building_material": {"brick": "cihlova", "panel": "panelova", "wood": "drevena", "wooden": "drevena", "stone": "kamenna"}, "ownership_type": {"personal": "osobni", "private": "osobni", "cooperative": "druzstevni"}}
OTHER_CODE = {"building_material": "jina"}
ROOM_COUNTS = ["oneRoom", "twoRooms", "threeRooms", "fourRooms", "fiveRooms"]


def typed_parameters(pages: DataFrame, body: str) -> DataFrame:
    """pages with attributes and unmapped, both maps of strings, of detail pages' parameters in a JSON column ({name: {value, options: [{id, title}]}}).

    attributes holds what TYPED names, read as its kind says and left out where it can't be. What TYPED doesn't name goes to unmapped, so that nothing is lost: the ids of chosen options and, as <name>_label, their titles; else the value.
    """
    kind_of = "struct<value:string,options:array<struct<id:string,title:string>>>"
    some = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    alone = lambda a: F.when(F.size(a) == 1, a[0])
    rows = pages.withColumn("__held", F.from_json(body, f"map<string,{kind_of}>"))  # each step is a column, so that it is worked out once
    rows = rows.withColumn("__said", F.transform_values("__held", lambda _, v: F.struct(F.nullif(v["value"], F.lit("")).alias("value"), F.coalesce(some(v["options"]["id"]), F.array().cast("array<string>")).alias("ids"), F.coalesce(some(v["options"]["title"]), F.array().cast("array<string>")).alias("titles"))))
    one = F.transform_values("__said", lambda _, v: F.struct(alone(v["ids"]).alias("code"), F.coalesce(v["value"], alone(v["titles"])).alias("text")))
    rows = rows.withColumn("__one", one)
    rows = rows.withColumns({f"__p{i}": F.try_element_at("__one", F.lit(name)) for i, (name, _, _) in enumerate(TYPED)})
    found: dict[str, Column] = {}
    for i, (_, attribute, kind) in enumerate(TYPED):
        code, text = F.col(f"__p{i}.code"), F.col(f"__p{i}.text")
        known = CODES.get(attribute, {})
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), code), F.lit(OTHER_CODE[attribute]) if attribute in OTHER_CODE else code) if known else code
        whole = F.trim(text).try_cast("double")
        if kind == "letter":
            read = F.upper(F.coalesce(code, text))
        elif kind == "code":
            read = F.when(code.isNotNull(), named)
        elif kind == "yes":
            both = F.lower(F.concat_ws(" ", text, code))
            read = F.when(both != "", (both.contains("ano") | both.isin("yes", "true")).cast("string"))
        elif kind == "area":
            number = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"\d[\d.]*", 0).try_cast("double")
            read = F.when(number > 0, number).cast("string")
        elif kind == "rooms":
            read = F.nullif(F.array_position(F.array(*map(F.lit, ROOM_COUNTS)), code), F.lit(0)).cast("string")
        else:
            read = F.when(whole >= 1 if kind == "count" else whole > 1800, whole).cast("int").cast("string")
        found[attribute] = F.coalesce(found[attribute], read) if attribute in found else read
    attributes = F.map_filter(F.create_map(*[x for a, v in found.items() for x in (F.lit(a), v)]), lambda _, v: v.isNotNull())
    typed = sorted({name for name, _, _ in TYPED})
    rows = rows.withColumns({"__attributes": attributes, "__rest": F.map_filter("__said", lambda k, _: ~k.isin(typed))})
    values = F.transform_values("__rest", lambda _, v: F.when(F.size(v["ids"]) > 0, F.array_join(v["ids"], ",")).otherwise(F.coalesce(v["value"], alone(v["titles"]))))
    labels = F.transform_keys(F.transform_values("__rest", lambda _, v: F.when(F.size(v["ids"]) > 0, F.nullif(F.array_join(v["titles"], ", "), F.lit("")))), lambda k, _: F.concat(k, F.lit("_label")))
    return rows.select(*pages.columns, F.col("__attributes").alias("attributes"), F.map_filter(F.map_concat(values, labels), lambda _, v: v.isNotNull()).alias("unmapped"))
