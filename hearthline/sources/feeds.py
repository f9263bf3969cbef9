"""Feeds with a fixed form: exchange rates, zone polygons, zone price quotations, crawl rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.money import parse_money
from hearthline.operators.latest import top_per_key

RATE = T.StructType([T.StructField("base", T.StringType()), T.StructField("quote", T.StringType()), T.StructField("rate", T.DecimalType(20, 10)), T.StructField("rate_date", T.DateType()), T.StructField("source", T.StringType())])


_ENVELOPE = "struct<Cube:struct<Cube:array<struct<_time:string,Cube:array<struct<_currency:string,_rate:string>>>>>>"


def rates_in_xml(bodies: DataFrame, body: str = "body", source: str = "ecb") -> DataFrame:
    """Rates of the central bank's XML, a document a row: a dated cube holds cubes with currency and rate. Entries without a rate are skipped."""
    envelope = F.from_xml(F.col(body), _ENVELOPE, {"ignoreNamespace": "true", "attributePrefix": "_"})
    rows = bodies.select(F.explode(envelope["Cube"]["Cube"]).alias("day")).select(F.col("day._time").alias("d"), F.explode("day.Cube").alias("c"))
    return rows.select(F.lit("EUR").alias("base"), F.col("c._currency").alias("quote"), F.col("c._rate").try_cast("decimal(20,10)").alias("rate"), F.to_date(F.try_to_timestamp("d")).alias("rate_date"), F.lit(source).alias("source")).where("rate is not null and rate_date is not null")


def daily_rates_xml(spark: SparkSession, path: str, source: str = "ecb") -> DataFrame:
    """The rates of XML files."""
    return rates_in_xml(spark.read.text(path, wholetext=True), "value", source)


def daily_rates_json(bodies: DataFrame, body: str = "body", source: str = "mirror") -> DataFrame:
    """Rates of a JSON mirror: {"base": "EUR", "rates": {date: {quote: number}}}; numbers are read as decimals, nulls skipped."""
    parsed = bodies.select(F.from_json(body, "struct<base:string,rates:map<string,map<string,decimal(20,10)>>>").alias("r")).where("r.base = 'EUR'")
    rows = parsed.select(F.explode("r.rates").alias("d", "m")).select("d", F.explode("m").alias("quote", "rate"))
    return rows.select(F.lit("EUR").alias("base"), "quote", "rate", F.col("d").try_cast("date").alias("rate_date"), F.lit(source).alias("source")).where("rate is not null and rate_date is not null")


def merged_rates(official: DataFrame, mirror: DataFrame, currencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rates, skipped): the official rate of a day before the mirror's; currencies that aren't known are skipped and counted by code."""
    both = official.withColumn("__p", F.lit(0)).unionByName(mirror.withColumn("__p", F.lit(1)))
    known = currencies.select(F.col("code").alias("quote"))
    rates = top_per_key(both.join(known, "quote", "left_semi"), ["base", "quote", "rate_date"], [F.asc("__p")]).select(*official.columns)
    return rates, both.join(known, "quote", "left_anti").groupBy("quote").agg(F.count("*").alias("n"))


_POINT = "array<double>"
FEATURES = f"type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def zone_features(spark: SparkSession, path: str, country: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(zones, errors) of the features in JSON files, each of which is one FeatureCollection."""
    return features_in(spark.read.schema(FEATURES).option("multiLine", True).json(path), country, source)


def features_of(bodies: DataFrame, country: str, source: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(zones, errors) of the features in a JSON column."""
    return features_in(bodies.select(F.from_json(body, f"struct<{FEATURES.replace('type string', 'type:string', 1).replace(' features array', 'features:array')}>").alias("c")).select("c.*"), country, source)


def features_in(collections: DataFrame, country: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(zones, errors) of FeatureCollections (type, features): external_code, name, level, parent_code, rings (of a multi-polygon the first part), country, source.

    Errors name what a feature lacks; a code that occurs twice is an error of both.
    """
    rows = collections.select("type", F.posexplode_outer("features").alias("feature", "f"))
    p = lambda k: F.nullif(F.trim(F.try_element_at("f.properties", F.lit(k))), F.lit(""))
    one = F.from_json("f.geometry.coordinates", f"array<array<{_POINT}>>")
    many = F.from_json("f.geometry.coordinates", f"array<array<array<{_POINT}>>>")
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", F.try_element_at(many, F.lit(1)))
    flat = rows.select("type", "feature", p("external_code").alias("external_code"), p("name").alias("name"), p("level").alias("level"), p("parent_code").alias("parent_code"),
                       F.transform(rings, lambda r: F.transform(r, lambda q: F.struct(F.try_element_at(q, F.lit(1)).alias("x"), F.try_element_at(q, F.lit(2)).alias("y")))).alias("rings"), F.lit(country.upper()).alias("country"), F.lit(source).alias("source"))
    twice = flat.where("external_code is not null").groupBy("external_code").agg(F.count("*").alias("__n"))
    flat = flat.join(twice, "external_code", "left")
    error = (F.when(F.col("type") != "FeatureCollection", "not_a_collection").when(F.col("name").isNull(), "no_name").when(F.coalesce(~F.col("level").isin("region", "municipality", "zone"), F.lit(True)), "bad_level")
             .when(F.col("rings").isNull() | (F.size("rings") == 0), "no_polygon").when(F.exists("rings", lambda r: F.size(r) < 4), "ring_too_short").when(F.col("__n") > 1, "duplicate_code"))
    checked = flat.withColumn("error", error).drop("__n", "type")
    return checked.where("error is null").drop("error"), checked.where("error is not null").select("feature", "external_code", "error")


def linked_by_code(zones: DataFrame) -> DataFrame:
    """zones (id, country, level, external_code, parent_code) with parent_id, and parent_problem where the code names no zone one level up."""
    up = zones.select("country", F.col("external_code").alias("parent_code"), F.col("id").alias("parent_id"), F.col("level").alias("__up")).where("parent_code is not null")
    wanted = F.when(F.col("level") == "zone", "municipality").when(F.col("level") == "municipality", "region")
    joined = zones.join(up, ["country", "parent_code"], "left")
    right = F.col("__up") == wanted
    return joined.withColumn("parent_problem", F.when(F.col("parent_code").isNotNull() & ~F.coalesce(right, F.lit(False)), "unresolved")).withColumn("parent_id", F.when(right, F.col("parent_id"))).drop("__up")


def period_start(text: Column) -> Column:
    """"2025/1", "2025-S2", "2025H1" -> the first day of the half year; null for another form or a year outside 1990 to 2100."""
    low = F.lower(F.trim(text))
    year, half = F.regexp_extract(low, r"^(\d{4})(?:/|-?[sh])([12])$", 1).try_cast("int"), F.regexp_extract(low, r"^(\d{4})(?:/|-?[sh])([12])$", 2)
    return F.when(year.between(1990, 2100), F.make_date(year, F.when(half == "1", 1).otherwise(7), F.lit(1)))


#: The columns of a quotation file and its words for deals.
QUOTATION_COLUMNS = ["codzona", "tipo", "contratto", "prezzo_min", "prezzo_max", "periodo"]
DEALS = {"vendita": "sale", "affitto": "rent"}


def quotations(rows: DataFrame, zones: DataFrame, country: str, source: str = "quotations", exponent: int = 2) -> tuple[DataFrame, DataFrame]:
    """(prices, errors) of rows with the columns of a quotation file. Nothing may be written unless errors is empty."""
    for name in QUOTATION_COLUMNS:
        if name not in rows.columns:
            raise ValueError(f"column {name} is missing")
    code = zones.where(F.col("country") == country).select(F.col("external_code").alias("codzona"), F.col("id").alias("zone_id"))
    deal = F.try_element_at(F.create_map(*[F.lit(x) for p in DEALS.items() for x in p]), F.lower(F.trim("contratto")))
    price = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", parse_money(F.trim(c), exponent))
    joined = rows.withColumn("codzona", F.trim("codzona")).join(code, "codzona", "left").select("*", deal.alias("deal"), period_start(F.col("periodo")).alias("period"), price("prezzo_min").alias("lo"), price("prezzo_max").alias("hi"))
    wrong = lambda c: F.col(f"{c}.error").isNotNull() | (F.col(f"{c}.minor") < 0)
    error = (F.when(F.coalesce("codzona", F.lit("")) == "", "no_zone").when(F.col("zone_id").isNull(), "unknown_zone").when(F.trim(F.coalesce("tipo", F.lit(""))) == "", "no_type").when(F.col("deal").isNull(), "bad_deal")
             .when(F.col("period").isNull(), "bad_period").when(wrong("lo"), "bad_price_min").when(wrong("hi"), "bad_price_max").when(F.col("hi.minor") < F.col("lo.minor"), "max_below_min"))
    checked = joined.withColumn("error", error)
    good = checked.where("error is null").select("zone_id", F.col("deal").alias("deal_type"), F.trim("tipo").alias("property_type"), F.col("lo.minor").alias("price_min_minor"), F.col("hi.minor").alias("price_max_minor"),
                                                 F.lit("EUR").alias("currency"), F.lit("per_sqm").alias("unit"), F.col("period").alias("period_start"), F.lit("transaction").alias("data_kind"), F.lit(source).alias("source"))
    return good, checked.where("error is not null").select(*QUOTATION_COLUMNS, "error")


def read_quotations(spark: SparkSession, path: str) -> DataFrame:
    """A quotation file with ',' or ';', whichever its first line holds; every column is text."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return spark.read.csv(path, header=True, sep=";" if ";" in line and "," not in line else ",", ignoreLeadingWhiteSpace=True, mode="FAILFAST")


def crawl_rules(files: DataFrame, text: str = "text", host: str = "host") -> DataFrame:
    """host, agent, allow, pattern, rule_no of robots files; agents that stand together share the rules that follow."""
    from pyspark.sql import Window

    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = files.select(F.col(host).alias("host"), F.posexplode(F.split(text, r"\r?\n")).alias("no", "line")).select("host", "no", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("host").orderBy("no")  # a file is some hundred lines
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by), F.lit("")) != "user-agent")
    grouped = rows.withColumn("s", starts.cast("int")).withColumn("g", F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    agents = grouped.where("field = 'user-agent'").select("host", "g", F.lower("value").alias("agent"))
    return grouped.where("field <> 'user-agent'").join(agents, ["host", "g"]).select("host", "agent", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.col("no").alias("rule_no"))


def crawl_allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls (unique url) with allowed: the longest pattern that fits decides, allow before disallow; without any it is allowed.

    Rules that name the agent replace those of "*". In a pattern * is any text and a final $ the end.
    """
    from hearthline.functions.urls import host

    mine = rules.where((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent")))
    named = mine.where("agent <> '*'").select("host").distinct().withColumn("__named", F.lit(True))
    mine = mine.join(named, "host", "left").where(F.when(F.col("__named"), F.col("agent") != "*").otherwise(F.col("agent") == "*")).where("pattern <> ''")
    bare = F.regexp_replace("pattern", r"\$$", "")
    expression = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(bare, r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*", ".*"), F.when(F.col("pattern").endswith("$"), "$").otherwise(""))
    sized = mine.select("host", "allow", expression.alias("__re"), F.length(bare).alias("__n"))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][\w+.\-]*:)?//[^/?#]*([^#]*)", 1)
    asked = urls.withColumn("host", host(F.col(url))).withColumn("__path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    fits = asked.join(sized, "host").where(F.regexp_like("__path", F.col("__re"))).groupBy(url).agg(F.max(F.struct("__n", "allow")).alias("__best"))
    return urls.join(fits, url, "left").withColumn("allowed", F.coalesce("__best.allow", F.lit(True))).drop("__best")
