"""Answers of a language model as attributes, translations that are due, detail pages merged into objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.classes import valid_value
from hearthline.operators.merging import merge_maps

ANSWER = "map<string,struct<value:string,confidence:double,quote:string,pattern:string>>"


def answer_json(text: Column) -> Column:
    """The JSON object of an answer: what follows a thought, without a code fence, from the first { to the last }."""
    plain = F.trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))
    inner = F.regexp_extract(F.regexp_replace(F.regexp_replace(plain, r"(?s)^```[^\n]*\n", ""), r"```\s*$", ""), r"(?s)\{.*\}", 0)
    return F.nullif(inner, F.lit(""))


def attributes_of(answers: DataFrame, registry: DataFrame, cap: float = 0.9, object_id: str = "object_id", answer: str = "answer", known: str = "attributes") -> tuple[DataFrame, DataFrame]:
    """(accepted, dropped): object_id, attr_key, value, confidence; and object_id, attr_key, reason.

    An attribute needs a registry entry that its value fits, and a confidence from 0 to 1, which is cut at cap. A total area whose quote speaks of
    the living area only is dropped, and so are both areas where the object's area would exceed its total area.
    """
    held = lambda key: F.try_element_at(F.col(known), F.lit(key)).try_cast("double")
    parsed = answers.select(object_id, held("area_sqm").alias("__area"), held("total_area").alias("__total"), F.from_json(answer_json(F.col(answer)), ANSWER).alias("a"))
    rows = parsed.select(object_id, "__area", "__total", F.explode("a").alias("attr_key", "e")).select(object_id, "__area", "__total", "attr_key", "e.*")
    joined = rows.join(registry.select(F.col("key").alias("attr_key"), "data_type", "allowed_values", "value_min", "value_max"), "attr_key", "left")
    said = F.lower(F.concat_ws(" ", "quote", "pattern"))
    living = (said.contains("obytn") | said.contains("užitn") | said.contains("uzitn")) & ~said.contains("celkov") & ~said.contains("total")
    wrong = valid_value(F.col("value"), F.col("data_type"), F.col("allowed_values"), F.col("value_min").cast("double"), F.col("value_max").cast("double"))
    reason = (F.when(F.col("value").isNull(), "no_value").when(F.col("data_type").isNull(), "unknown_key").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence").when(wrong.isNotNull(), wrong)
              .when((F.col("attr_key") == "total_area") & living, "living_area"))
    judged = joined.withColumn("reason", reason).withColumn("confidence", F.least("confidence", F.lit(cap))).withColumn("value", F.when(F.col("data_type").isin("bool", "enum"), F.lower(F.trim("value"))).otherwise(F.trim("value")))
    number = lambda key: F.max(F.when((F.col("attr_key") == key) & F.col("reason").isNull(), F.col("value").try_cast("double")))
    # only rows of areas are grouped and joined; a null key counts as another attribute
    of_area = F.coalesce(F.col("attr_key").isin("area_sqm", "total_area"), F.lit(False))
    areas = judged.where(of_area).groupBy(object_id).agg(number("area_sqm").alias("__a"), number("total_area").alias("__t"), F.max("__area").alias("__ka"), F.max("__total").alias("__kt"))
    clash = areas.where(F.coalesce("__a", "__ka") > F.coalesce("__t", "__kt")).select(object_id, F.lit(True).alias("__clash"))
    checked = judged.where(of_area).join(clash, object_id, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__clash"), "area_over_total"))).drop("__clash")
    final = judged.where(~of_area).unionByName(checked)
    return final.where("reason is null").select(object_id, "attr_key", "value", "confidence"), final.where("reason is not null").select(object_id, "attr_key", "reason")


def normalised_attributes(raw: Column) -> Column:
    """A JSON object as map of text: true and 3.50 become "true" and "3.5", text stays as it is."""
    held = F.from_json(raw, "map<string,string>")
    return F.transform_values(held, lambda _, v: F.when(v.rlike(r"^-?\d+\.\d*0+$"), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON scalars are the same value: 1 and 1.0 are, true and "true" aren't."""
    number = lambda c: F.when(~c.startswith('"'), c.try_cast("double"))
    return F.coalesce(number(a) == number(b), F.trim(a) == F.trim(b))


def pending_translations(objects: DataFrame, translations: DataFrame, wanted: tuple[str, ...] = ("ru", "en")) -> DataFrame:
    """object_id, lang: the languages that an object's present text has no translation to."""
    texts = objects.where(F.coalesce("description_original", F.lit("")) != "").select("object_id", F.sha2("description_original", 256).alias("source_hash"), F.explode(F.array_except(F.array(*map(F.lit, wanted)), F.array("language_original"))).alias("lang"))
    return texts.join(translations.select("object_id", "source_hash", "lang"), ["object_id", "source_hash", "lang"], "left_anti").select("object_id", "lang")


def reusable_translations(pending: DataFrame, objects: DataFrame, translations: DataFrame) -> DataFrame:
    """object_id, lang, text for pending ones where another object with the same text has a translation; of several the smallest id's."""
    texts = objects.select("object_id", F.sha2("description_original", 256).alias("source_hash"))
    known = translations.groupBy("source_hash", "lang").agg(F.min_by("text", "object_id").alias("text"))
    return pending.join(texts, "object_id").join(known, ["source_hash", "lang"]).select("object_id", "lang", "text")


def merge_details(objects: DataFrame, details: DataFrame, fetched_at: Column) -> DataFrame:
    """objects updated by parsed detail pages (one row per id): what a page doesn't state stays.

    A position that differs makes the zone due again and takes back the mark that no zone will be found.
    """
    known = [c for c in ("description_original", "area_sqm", "rooms", "address", "seller_type", "seller_name", "geo_confidence", "geo_source") if c in objects.columns and c in details.columns]
    d = details.select("id", *[F.col(c).alias(f"__{c}") for c in (*known, "lat", "lng", "detail_hash", "attributes")], F.lit(True).alias("__found"))
    moved = F.col("__lat").isNotNull() & ~(F.col("lat").eqNullSafe(F.col("__lat")) & F.col("lng").eqNullSafe(F.col("__lng")))
    text = lambda c: F.nullif(F.col(f"__{c}"), F.lit("")) if dict(objects.dtypes)[c] == "string" else F.col(f"__{c}")
    new = {c: F.coalesce(text(c), F.col(c)) for c in known}
    new |= {c: F.when(F.col("__lat").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("lat", "lng")}
    new |= {"attributes": F.when(F.col("__attributes").isNull(), F.col("attributes")).otherwise(merge_maps(F.col("attributes"), F.col("__attributes"))), "detail_hash": F.coalesce("__detail_hash", "detail_hash"),
            "detail_fetched_at": F.when(F.col("__found"), fetched_at).otherwise(F.col("detail_fetched_at")), "zone_dirty": F.col("zone_dirty") | moved, "zone_terminal": F.col("zone_terminal") & ~moved}
    return objects.join(d, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in objects.columns])


def days_on_market(first_seen: Column, last_seen: Column, delisted_at: Column, status: Column, now: Column) -> Column:
    end = F.when(status == "delisted", F.coalesce(delisted_at, last_seen)).otherwise(now)
    return F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(first_seen)) / 86_400_000_000), F.lit(0)).cast("int")
