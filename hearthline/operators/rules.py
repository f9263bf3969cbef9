"""Attribute rules held as data: apply them to texts, mine new ones, promote, shadow and demote them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.areas import Area, Text, area_at, chosen
from hearthline.functions.text import czech_number, mine_guard, normalised
from hearthline.operators.phrases import Finder

AREA_KEYS = ("area_sqm", "total_area")
MOST_RULES = 5000


@dataclass(frozen=True)
class Rule:
    """A phrase or pattern for one attribute; value is its JSON text, None where the pattern's number is the value."""

    id: int
    key: str
    kind: str  # literal or regex
    pattern: str
    value: str | None
    confidence: float
    low: float | None = None
    high: float | None = None
    promoted: bool = False

    @property
    def java(self) -> str:
        return self.pattern.replace("(?P<", "(?<")

    @property
    def group(self) -> int:
        compiled = regex.compile(self.pattern.replace("(?P<", "(?<"))
        if not compiled.groups:
            raise ValueError(f"rule {self.id}: a pattern without a value needs a group for its number")
        return compiled.groupindex.get("val", 1)


def load(templates: DataFrame, registry: DataFrame, country: str) -> list[Rule]:
    """The active rules of a country in order of id. Operators edit this table by hand; more than MOST_RULES rows are an error."""
    bounds = registry.where(F.col("country") == country).select(F.col("key").alias("attr_key"), "value_min", "value_max")
    rows = templates.where((F.col("country") == country) & (F.col("status") == "active")).join(bounds, "attr_key", "left").orderBy("id").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} active rules")
    real = lambda v: None if v is None else float(v)
    return [Rule(r["id"], r["attr_key"], r["pattern_type"], r["pattern"], r["value"], float(r["confidence"]), real(r["value_min"]), real(r["value_max"]), r["promoted_at"] is not None) for r in rows]


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()


def fired(text: Column, pattern: Column, value: Column, low: Column, high: Column, group: Column) -> Column:
    """A rule's value in one normalised text, null where it doesn't fire: the rule is a row's columns, and its pattern is compiled when it changes from row to row.

    Without a value, the pattern's number counts, the first between low and high.
    """
    numbers = F.transform(F.regexp_extract_all(text, pattern, group), czech_number)
    inside = F.filter(numbers, lambda n: n.isNotNull() & (n >= F.coalesce(low, n)) & (n <= F.coalesce(high, n)))
    return F.when(value.isNull(), F.try_element_at(inside, F.lit(1)).cast("string")).when(F.regexp_instr(text, pattern) > 0, value)


def _candidates(title: Column, text: Column, rules: list[Rule]) -> Column:
    """Rules by their place in the list, in order: k where literal k fires, -k - 1 where pattern k has to be tried. Of an attribute's literals only the first that fires, and no pattern after it."""
    keys = [r.key for r in rules]
    finder: list[Finder] = []  # made once a task

    @F.pandas_udf("array<int>")
    def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
        if not finder:
            finder.append(Finder([(k, _plain(r.pattern)) for k, r in enumerate(rules) if r.kind == "literal" and r.value is not None and _plain(r.pattern)],
                                 [(k, r.java) for k, r in enumerate(rules) if r.kind != "literal" and not _is_area(r)]))
        out = []
        for both in zip(titles, texts):
            sure, maybe = finder[0].in_texts(both)
            first: dict[str, int] = {}
            for k in sorted(sure):
                first.setdefault(keys[k], k)
            out.append([*first.values(), *(-k - 1 for k in sorted(maybe) if k < first.get(keys[k], k + 1))])
        return pd.Series(out, dtype=object)

    return run(title, text)


def _is_area(rule: Rule) -> bool:
    return rule.key in AREA_KEYS and rule.kind == "regex" and rule.value is None


def _area_hit(title: Column, text: Column, rules: list[Rule], total: bool) -> Column:
    """The number that the area rules find and the area choice picks, with the rule it came from."""
    compiled = [(regex.compile(r.java), r.group) for r in rules]
    finder: list[Finder] = []  # made once a task

    @F.pandas_udf("struct<value:double,rule:int>")
    def run(titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        if not finder:
            finder.append(Finder([], [(i, r.java) for i, r in enumerate(rules)]))
        out = []
        for both in zip(titles, texts):
            found: list[tuple[Area, int]] = []
            sources = [Text(source) for source in both if source]
            for i in sorted(finder[0].in_texts([source.text for source in sources])[1]):
                pattern, group = compiled[i]
                for source in sources:
                    stated = (area_at(source, m.start(group), m.end(group), m.end()) for m in pattern.finditer(source.text) if m[group])
                    found += [(area, i) for area in stated if area]
            picked = chosen([a for a, _ in found], total)
            out.append((picked.value, next(i for a, i in found if a is picked)) if picked else (None, None))
        return pd.DataFrame(out, columns=["value", "rule"]).astype({"rule": "Int32"})

    return run(title, text)


def apply_rules(objects: DataFrame, rules: list[Rule], keys: list[str], id_col: str = "object_id", title: str = "title", text: str = "description") -> DataFrame:
    """object_id, attr_key, value, confidence, rule_id, promoted: one row per object and attribute that a rule finds.

    Rules go in order of the list, the title before the text, and the first hit of an attribute counts; area rules come last. One automaton of all phrases, and of the strings that patterns can't do without, reads each
    text once; only the patterns it names are tried, as rows. So the work grows with what is found, not with the number of rules. Ids are unique.
    """
    rules = [r for r in rules if r.key in keys]
    kind = "object_id long, attr_key string, value string, confidence double, rule_id long, promoted boolean"
    spark = objects.sparkSession
    if not rules:
        return spark.createDataFrame([], kind)
    plain = objects.select(F.col(id_col).cast("long").alias("object_id"), normalised(F.coalesce(F.col(title), F.lit(""))).alias("t"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("d"))
    by_number = lambda r: r.kind != "literal" and r.value is None and not _is_area(r)
    book = spark.createDataFrame([(k, r.key, r.java if r.kind != "literal" else "", r.value, *(None if v is None else float(v) for v in (r.low, r.high)), r.group if by_number(r) else 0, float(r.confidence), r.id, r.promoted) for k, r in enumerate(rules)],
                                 "place int, attr_key string, pattern string, said string, low double, high double, number int, confidence double, rule_id long, promoted boolean")
    tried = plain.select("object_id", "t", "d", F.explode(_candidates(F.col("t"), F.col("d"), rules)).alias("found"))
    tried = tried.withColumn("place", F.when(F.col("found") < 0, -F.col("found") - 1).otherwise(F.col("found"))).join(F.broadcast(book), "place")  # rules are bounded by MOST_RULES where they are loaded
    columns = [F.col(c) for c in ("pattern", "said", "low", "high", "number")]
    hits = tried.select("object_id", "attr_key", "place", F.when(F.col("found") >= 0, F.col("said")).otherwise(F.coalesce(fired(F.col("t"), *columns), fired(F.col("d"), *columns))).alias("value"), "confidence", "rule_id", "promoted")
    for key in AREA_KEYS:
        if areas := [r for r in rules if r.key == key and _is_area(r)]:
            hit = plain.select("object_id", _area_hit(F.col("t"), F.col("d"), areas, key == "total_area").alias("hit")).where("hit.value is not null")
            own = spark.createDataFrame([(i, key, float(r.confidence), r.id, r.promoted) for i, r in enumerate(areas)], "rule int, attr_key string, confidence double, rule_id long, promoted boolean")
            hits = hits.unionByName(hit.select("object_id", F.col("hit.rule").alias("rule"), F.col("hit.value").cast("string").alias("value")).join(F.broadcast(own), "rule").withColumn("place", F.col("rule") + len(rules)).drop("rule"))
    first = F.min(F.struct("place", "value", "confidence", "rule_id", "promoted")).alias("first")
    return hits.where("value is not null").groupBy("object_id", "attr_key").agg(first).select("object_id", "attr_key", "first.value", "first.confidence", "first.rule_id", "first.promoted")


def missing_attributes(objects: DataFrame, registry: DataFrame, provenance: DataFrame) -> DataFrame:
    """object_id, attr_key of the country's registry that an object neither holds nor has provenance of."""
    wanted = objects.select("object_id", "country", "attributes").join(registry.select("country", F.col("key").alias("attr_key")), "country")
    gaps = wanted.where(~F.map_contains_key("attributes", F.col("attr_key"))).select("object_id", "attr_key")
    return gaps.join(provenance.select("object_id", "attr_key").distinct(), ["object_id", "attr_key"], "left_anti")


def mine(templates: DataFrame, events: DataFrame, examples: int = 5) -> DataFrame:
    """templates (country, attr_key, pattern, value, status, confidence, occurrences, conflicts, example_object_ids, last_ids) after mined events.

    events: seq, country, attr_key, pattern, quote, text, value, confidence, object_id. An event that fails the guards or has no confidence is left out. A
    new pattern takes the value of its first event. An object with that value counts once as an occurrence; other values are conflicts, which take a candidate or
    active rule out of use. Confidence only falls. The two latest confirmations are kept for the check at promotion; the rest are only counted.
    """
    key = ["country", "attr_key", "pattern"]
    sound = events.where(mine_guard(F.col("pattern"), F.col("quote"), F.col("text")).isNull() & (F.col("confidence") > 0)).withColumn("pattern", F.trim("pattern"))
    first = sound.groupBy(*key).agg(F.min_by("value", "seq").alias("first_value"), F.min("confidence").alias("mined_confidence"))
    held = first.join(templates, key, "left").select(*key, F.coalesce("value", "first_value").alias("value"), "mined_confidence", "status", "confidence", "occurrences", "conflicts", "example_object_ids", "last_ids")
    rows = sound.select(*key, "seq", "object_id", F.col("value").alias("said")).join(held.select(*key, "value", F.coalesce("last_ids", F.expr("array()").cast("array<bigint>")).alias("seen")), key)
    confirming = rows.where((F.col("said") == F.col("value")) & ~F.array_contains("seen", F.col("object_id"))).groupBy(*key, "object_id").agg(F.min("seq").alias("seq"))
    confirmed = confirming.groupBy(*key).agg(F.count("*").alias("more"), F.max(F.struct("seq", "object_id")).alias("newest"))
    second = confirming.join(confirmed, key).where(F.col("seq") < F.col("newest.seq")).groupBy(*key).agg(F.max(F.struct("seq", "object_id")).alias("before"))
    clashes = rows.where(F.col("said") != F.col("value")).groupBy(*key).agg(F.count("*").alias("clashes"))
    # the smallest ids are kept: of each task's rows at most `examples` reach the merge
    ids = rows.select(*key, "object_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("object_id"))).where(F.col("k") <= examples).groupBy(*key).agg(F.array_sort(F.collect_list("object_id")).alias("new_ids"))
    joined = held.join(confirmed, key, "left").join(second, key, "left").join(clashes, key, "left").join(ids, key, "left")
    none = F.expr("array()").cast("array<bigint>")
    clash = F.coalesce("clashes", F.lit(0))
    last = F.filter(F.array(F.col("before.object_id"), F.col("newest.object_id")), lambda i: i.isNotNull())
    chain = F.concat(F.coalesce("last_ids", none), last)
    status = F.coalesce("status", F.lit("candidate"))
    changed = joined.select(
        *key, "value", F.when((clash > 0) & status.isin("candidate", "active"), "conflict").otherwise(status).alias("status"), F.least(F.coalesce("confidence", "mined_confidence"), F.col("mined_confidence")).alias("confidence"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("occurrences"), (F.coalesce("conflicts", F.lit(0)) + clash).cast("long").alias("conflicts"),
        F.slice(F.array_sort(F.array_union(F.coalesce("example_object_ids", none), F.coalesce("new_ids", none))), 1, examples).alias("example_object_ids"),
        F.slice(chain, F.greatest(F.size(chain) - 1, F.lit(1)), F.lit(2)).alias("last_ids"))
    return changed.unionByName(templates.select(*changed.columns).join(changed.select(*key), key, "left_anti"))


def _ready(templates: DataFrame, least: int) -> DataFrame:
    """Candidates with enough confirmations and no conflict; least <= 0 promotes nothing."""
    return templates.where((F.col("status") == "candidate") & (F.col("conflicts") == 0) & (F.col("occurrences") >= least) & (F.size("last_ids") == 2) & F.lit(least > 0))


def promotable(templates: DataFrame, firings: DataFrame, current: DataFrame, least: int = 5) -> DataFrame:
    """country, attr_key, pattern of candidates whose two latest confirmations still fire with the object's present value.

    firings: pattern, object_id, attr_key, value that the rule gives now; current: object_id, attr_key, value the object holds. least <= 0 promotes nothing.
    """
    key = ["country", "attr_key", "pattern"]
    asked = _ready(templates, least).select(*key, F.explode("last_ids").alias("object_id"))
    fired_now = asked.join(firings, ["attr_key", "pattern", "object_id"], "left").join(current.withColumnRenamed("value", "held"), ["object_id", "attr_key"], "left")
    return fired_now.groupBy(*key).agg(F.bool_and(F.coalesce(F.col("value") == F.col("held"), F.lit(False))).alias("ok")).where("ok").drop("ok")


def _number_group(pattern: Column) -> Column:
    """Which group of a pattern holds its number: the one named val, else the first."""
    @F.pandas_udf("int")
    def run(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: regex.compile(p).groupindex.get("val", 1))

    return run(pattern)


def replay(rules: DataFrame, objects: DataFrame, pairs: DataFrame, id_col: str = "object_id", title: str = "title", text: str = "description") -> DataFrame:
    """country, attr_key, pattern, object_id, value: what a rule gives on an object now, for the pairs (country, attr_key, pattern, object_id) in which it fires.

    rules: country, attr_key, pattern, value, and pattern_type, value_min, value_max (literal and no bounds where absent). Only the texts of the paired objects are read, and no rule meets other objects; pairs are dealt and sorted
    by pattern and object, so that a task compiles each of its patterns once, however many objects a pattern has.
    """
    key = ["country", "attr_key", "pattern"]
    have = lambda c, default: F.col(c) if c in rules.columns else F.lit(default)
    literal = F.coalesce(have("pattern_type", "literal"), F.lit("literal")) == "literal"
    phrase = normalised(F.col("pattern"))
    java = F.when(literal, F.concat(F.lit(r"(?<![\p{L}\p{Nd}])\Q"), phrase, F.lit(r"\E(?![\p{L}\p{Nd}])"))).otherwise(F.replace(F.col("pattern"), F.lit("(?P<"), F.lit("(?<")))
    book = rules.where(~literal | (F.length(phrase) > 0)).select(*key, java.alias("java"), F.col("value").alias("said"), have("value_min", None).cast("double").alias("low"), have("value_max", None).cast("double").alias("high"))
    valued, dynamic = book.where("said is not null"), book.where("said is null")
    book = valued.withColumn("number", F.lit(0)).unionByName(dynamic.withColumn("number", _number_group(F.col("java"))))
    plain = objects.select(F.col(id_col).cast("long").alias("object_id"), normalised(F.coalesce(F.col(title), F.lit(""))).alias("t"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("d"))
    rows = pairs.select(*key, "object_id").distinct().join(book, key).join(plain, "object_id").repartition("java", "object_id").sortWithinPartitions("java", "object_id")
    columns = [F.col(c) for c in ("java", "said", "low", "high", "number")]
    return rows.select(*key, "object_id", F.coalesce(fired(F.col("t"), *columns), fired(F.col("d"), *columns)).alias("value")).where("value is not null")


def promoted(templates: DataFrame, objects: DataFrame, current: DataFrame, at: Column, least: int = 5) -> DataFrame:
    """templates with the candidates that hold on their two latest confirmations made active; those get promoted_at, where templates have that column."""
    key = ["country", "attr_key", "pattern"]
    ready = _ready(templates, least)
    firings = replay(ready, objects, ready.select(*key, F.explode("last_ids").alias("object_id"))).drop("country")
    rise = promotable(templates, firings, current, least).withColumn("__rises", F.lit(True))
    after = templates.join(rise, key, "left")
    rises = F.col("__rises").isNotNull()
    new = {"status": F.when(rises, "active").otherwise(F.col("status"))} | ({"promoted_at": F.when(rises, at).otherwise(F.col("promoted_at"))} if "promoted_at" in templates.columns else {})
    return after.select(*[new[c].alias(c) if c in new else F.col(c) for c in templates.columns])


def settle_shadow(templates: DataFrame, checks: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, checks) after verdicts (template_id, object_id, attr_key, llm_value) on pending checks.

    A check is done if the values agree, else a mismatch; an active template with a mismatch is demoted.
    """
    key = ["template_id", "object_id", "attr_key"]
    joined = checks.join(verdicts.withColumnRenamed("llm_value", "__said"), key, "left")
    due = (F.col("status") == "pending") & F.col("__said").isNotNull()
    status = F.when(due, F.when(F.col("template_value") == F.col("__said"), "done").otherwise("mismatch")).otherwise(F.col("status"))
    after = joined.withColumn("llm_value", F.when(due, F.col("__said")).otherwise(F.col("llm_value"))).withColumn("__new", due & (status == "mismatch")).withColumn("status", status)
    wrong = after.where("__new").groupBy(F.col("template_id").alias("id")).agg(F.count("*").alias("__wrong"))
    fell = templates.join(wrong, "id", "left").withColumn("status", F.when((F.col("__wrong") > 0) & (F.col("status") == "active"), "demoted").otherwise(F.col("status")))
    fell = fell.withColumn("shadow_mismatches", F.col("shadow_mismatches") + F.coalesce("__wrong", F.lit(0)))
    return fell.select(*templates.columns), after.select(*checks.columns)
