"""How operators run: what is shuffled instead of broadcast, how rows are dealt over tasks, and results that don't hang on the order of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it registers the queries
from hearthline.operators import catalog, matching, spatial
from hearthline.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_keys_are_shuffled(spark):
    """What is left after deletions is many times the keys, which the planner doesn't see."""
    keys = spark.range(100).select(F.format_string("customer%09d", "id").alias("k"))
    assert "Broadcast" not in plan_of(matching.similar_keys(keys, "k", 0.9))


def test_cover_of_equal_numbers(spark):
    objects = spark.createDataFrame([(1,)], "id long")
    for urls in (["b", "a", "c"], ["a", "c", "b"]):
        photos = spark.createDataFrame([(1, 7, u) for u in urls], "object_id long, ord int, original_url string").coalesce(1)
        assert catalog.with_cover(objects, photos).first()["cover"] == "a"


@pytest.mark.parametrize("name", ["i22_area_numbers", "a09_label_blocks", "i21_attributes"])
def test_rows_are_dealt_over_tasks(spark, name):
    """A million parts lie in one row group, so one task read and parsed them all."""
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_parents_are_sought_one_level_up(spark, monkeypatch):
    """Zones that share a cell with many of their own level don't meet them."""
    seen, real = [], spatial.covering_pairs
    monkeypatch.setattr(spatial, "covering_pairs", lambda points, zones, *more: seen.append(zones) or real(points, zones, *more))
    ring = lambda a, b: [[{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]]
    zones = spark.createDataFrame([(1, "X", "region", ring(0.0, 1.0)), (2, "X", "municipality", ring(0.1, 0.6)), (3, "X", "zone", ring(0.2, 0.3)), (4, "X", "zone", ring(0.7, 0.8))], "id long, country string, level string, rings array<array<struct<x:double,y:double>>>")
    got = spatial.link_parents(zones)
    assert {r["level"] for r in seen[0].select("level").collect()} == {"municipality", "region"}
    assert {r["id"]: r["parent_id"] for r in got.collect()} == {1: None, 2: 1, 3: 2, 4: None}


def test_only_losers_look_again(spark, monkeypatch):
    """Each round ranked and read the candidates of all listings; now a place's are ranked once, and a listing that holds its object isn't looked at again."""
    seen, real = [], matching._judged
    monkeypatch.setattr(matching, "_judged", lambda active, *more: seen.append(sorted(r["listing_id"] for r in active.select("listing_id").collect())) or real(active, *more))
    market = "country string, deal_type string, lat double, lng double, address_key string, rooms int, property_type string, area_sqm double"
    at = lambda n: ("CZ", "sale", 50.0 + n, 14.0, "", 1, "flat", 50.0)
    objects = spark.createDataFrame([(i, *at(0)) for i in (1, 2, 3)] + [(9, *at(1))], f"object_id long, {market}")
    listings = spark.createDataFrame([(10 + i, "a", str(i), *at(0)) for i in range(4)] + [(20, "a", "x", *at(1))], f"listing_id long, source_id string, external_id string, {market}")
    got = matching.match_listings(listings, objects, spark.createDataFrame([], "source_id string, external_id string, object_id long"), nearest=1)
    assert {r["listing_id"]: r["object_id"] for r in got.collect()} == {10: 1, 11: 2, 12: 3, 13: None, 20: 9}
    assert seen == [[10, 11, 12, 13, 20], [11, 12, 13], [12, 13], [12, 13], [13]]


def test_crowded_places_look_near_first(spark, monkeypatch):
    """All objects within the radius were ranked for each place, pairs that grow with the square of a crowd; now those farther out are sought when the nearer ones are used up."""
    seen, real = [], matching.near_pairs
    monkeypatch.setattr(matching, "near_pairs", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rng = random.Random(3)
    market = "country string, deal_type string, lat double, lng double, address_key string, rooms int, property_type string, area_sqm double"
    rows = lambda first, n, more: [(first + i, *more(i), "CZ", "sale", 50 + rng.random() * 0.0006, 14 + rng.random() * 0.0009, "", rng.randint(1, 2), "flat", 50.0) for i in range(n)]
    objects, listings = rows(0, 300, lambda i: ()), rows(1000, 250, lambda i: ("ab"[i % 5 == 0], str(i)))
    links = spark.createDataFrame([], "source_id string, external_id string, object_id long")
    got = matching.match_listings(spark.createDataFrame(listings, f"listing_id long, source_id string, external_id string, {market}"), spark.createDataFrame(objects, f"object_id long, {market}"), links, nearest=2)
    got = {r["listing_id"]: r["object_id"] for r in got.collect()}
    rad, taken, want, within = math.radians, {"a": set(), "b": set()}, {}, 0
    for id_, source, _, _, _, la, lo, _, rooms, *_ in listings:
        far = lambda o: 2000 * 6371 * math.asin(math.sqrt(math.sin(rad(o[3] - la) / 2) ** 2 + math.cos(rad(la)) * math.cos(rad(o[3])) * math.sin(rad(o[4] - lo) / 2) ** 2))  # noqa: B023, E731
        near = sorted((far(o), o[0], o[6]) for o in objects if far(o) <= 50)
        within += len(near)
        want[id_] = next((o for _, o, r in [x for x in near if x[1] not in taken[source]][:2] if r == rooms), None)
        taken[source] |= {want[id_]} - {None}
    assert got == want
    assert len(seen) > 1 and seen[0].count() < within / 2


def test_answers_are_hashed(spark):
    """Only rows of areas are grouped; a map in the groups made each task sort all its answers."""
    assert "SortAggregate" not in plan_of(QUERIES["i27_model_answers"](spark, "/root/testdata/sf0.001"))


def test_parts_are_dealt_by_key(spark):
    """A million parts are few bytes, so one task sorted them all; dealing them by key needs no sort."""
    plan = plan_of(QUERIES["k08_rule_life"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(p_partkey#" in plan and f", {4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan
