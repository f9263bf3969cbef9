"""Operators on small fixtures: matching, zones, delisting, rules, schedules, queues, invariants."""

import datetime as dt
import itertools
import math
import random
import re
import statistics

import pytest
import regex
from pyspark.sql import functions as F

from hearthline.functions import areas
from hearthline.operators import asof, catalog, delisting, latest, matching, merging, quality, queues, ranks, rules, scheduling, spatial
from hearthline.operators.medians import exact_median
from hearthline.operators.phrases import needed
from hearthline.operators.trigrams import TrigramIndex

T0 = dt.datetime(2026, 8, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


# catalogue ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def market(spark):
    """Twelve objects: ten points, one with a zone only, one without a position."""
    price = [10000, 20000, 30000, 40000, 50000, 60000, None, 80000, 1000000, 5000, 15000, 70000]
    area = [50.0, 50.0, 55.0, 60.0, 100.0, 25.0, None, 10.0, 1000.0, 9.5, 33.0, 40.0]
    rooms = [2, 3, 2, 1, 4, 2, None, 2, 2, 2, None, None]
    seller = ["private", "agency", "developer", "private", "auction_organizer"] + ["private"] * 5 + ["agency", "private"]
    rows = [(i, "CZ", "sale", "active", 1 if i == 11 else None, 14.35 + i / 1000 if i < 11 else None, 50.05 + i / 1000 if i < 11 else None, f"Special {i}", area[i - 1], rooms[i - 1], price[i - 1], seller[i - 1], None if i == 12 else "zone" if i == 11 else "street", day(i), "CZK") for i in range(1, 13)]
    objects = spark.createDataFrame(rows, "id long, country string, deal_type string, status string, zone_id long, lng double, lat double, address string, area_sqm double, rooms int, current_price_minor long, seller_type string, geo_confidence string, first_seen_at timestamp, currency string")
    deviation = {1: -0.2, 2: -0.1, 3: 0.0, 4: 0.1, 5: 0.3, 11: -0.07}
    values = spark.createDataFrame([(i, 1, day(0), 9.9) for i in deviation] + [(i, 2, day(1), v) for i, v in deviation.items()] + [(12, 1, day(1), 0.5)], "object_id long, id long, computed_at timestamp, price_deviation double")
    photos = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "object_id long, ord int, original_url string")
    return objects, values, photos


def listed(market, **params):
    page, total = catalog.list_objects(*market, params)
    return [r["id"] for r in page.collect()], total.first()["total"]


def test_orderings(market):
    want = {"date_desc": [*range(12, 0, -1)], "date_asc": [*range(1, 13)], "price_asc": [10, 1, 11, 2, 3, 4, 5, 6, 12, 8, 9, 7], "price_desc": [9, 8, 12, 6, 5, 4, 3, 2, 11, 1, 10, 7], "deviation_asc": [1, 2, 11, 3, 4, 5, 12, 10, 9, 8, 7, 6],
            "deviation_desc": [5, 4, 3, 11, 2, 1, 12, 10, 9, 8, 7, 6], "ppsm_asc": [1, 2, 11, 5, 10, 3, 4, 9, 12, 6, 8, 7], "ppsm_desc": [8, 6, 12, 9, 4, 3, 10, 5, 11, 2, 1, 7]}
    for sort, ids in want.items():
        assert listed(market, sort=sort)[0] == ids, sort
    assert listed(market, sort="price_asc", page=2, per_page=5) == ([4, 5, 6, 12, 8], 12)


def test_filters(market):
    for n, params in [(12, {"q": "Special"}), (9, {"price_min": 10001}), (2, {"price_min": 10001, "price_max": 25000}), (4, {"area_min": 55}), (6, {"rooms": 2}), (1, {"zone_id": 1}), (0, {"zone_id": 99}), (2, {"seller_type": "agency"}), (2, {"seller_type": "agency", "dev_class": "below"}),
                      (1, {"dev_class": "far_below"}), (2, {"dev_class": "below"}), (1, {"dev_class": "near"}), (1, {"dev_class": "far_above"}), (6, {"dev_class": "none"}), (1, {"has_photo": "true"}), (11, {"has_photo": "false"}), (3, {"bbox": "14.3505,50,14.3535,51"})]:
        assert listed(market, **params)[1] == n, params
    for params in [{"price_min": 5, "price_max": 4}, {"rooms": 0}, {"rooms": 99}, {"price_min": -1}, {"color": "x"}, {"q": "S"}, {"seller_type": "x"}, {"dev_class": "x"}, {"has_photo": "x"}, {"sort": "x"}, {"price_min": "a"}, {"per_page": 500}]:
        with pytest.raises(ValueError):
            listed(market, **params)


def test_map(spark, market):
    rows = catalog.with_latest_valuation(market[0], market[1])
    kind, points = catalog.map_view(rows, 14, (14.2, 49.9, 14.6, 50.3))
    assert (kind, points.count()) == ("points", 10)
    kind, cells = catalog.map_view(rows, 14, (14.2, 49.9, 14.6, 50.3), points_max=5)
    assert kind == "cells" and sum(r["n"] for r in cells.collect()) == 10
    assert [tuple(r) for r in catalog.map_areas(rows).collect()] == [(1, 1, "below", False)]
    with pytest.raises(ValueError):
        catalog.map_view(rows, 5, (-180, -90, 180, 90))
    tied = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, v string")
    assert sorted(tuple(r) for r in latest.majority(tied, ["k"], "v").collect()) == [(1, 2, None, True), (2, 1, "a", False)]


def test_enriched_lists(spark, market):
    history = spark.createDataFrame([(1, 1, day(0), 100), (1, 2, day(1), 90), (2, 1, day(0), 5), (3, 1, day(0), 5), (3, 2, day(1), 7)], "object_id long, id long, change_at timestamp, price_minor long")
    rows = {r["id"]: r for r in catalog.with_cover(catalog.with_trend(market[0], history), market[2]).collect()}
    assert [rows[i]["price_trend"] for i in (1, 2, 3, 4)] == ["reduced", None, "increased", None] and rows[1]["cover"] == "a" and rows[2]["cover"] is None
    described = spark.createDataFrame([(1, "text"), (2, "new")], "id long, description_original string")
    told = spark.createDataFrame([(1, "982d9e3eb996f559e633f4d194def3761d909f5a3b647d1a851fead67c32c9d1", "ru", "ТЕКСТ"), (2, "old", "ru", "x")], "object_id long, source_hash string, lang string, text string")
    assert {r["id"]: (r["text_ru"], r["text_en"]) for r in catalog.with_translations(described, told).collect()} == {1: ("ТЕКСТ", None), 2: (None, None)}
    active = market[0].withColumn("zone_id", F.lit(1).cast("long"))
    card = catalog.zone_cards(active, history, least=2).first()
    assert (card["n"], card["n_history"], card["n_down"], card["down_share"], card["trend_reason"]) == (12, 2, 1, 0.5, None)
    assert card["mean_minor"] == round(1380000 / 12)
    states = catalog.model_states(market[0], spark.createDataFrame([(1, 1, day(0), 0.1, None, 0.5, 10, False, "v1"), (2, 1, day(0), None, "no_zone: x", None, None, True, "v1"), (3, 1, day(0), None, "no_area", None, None, False, "v1")], "object_id long, id long, computed_at timestamp, price_deviation double, deviation_null_reason string, r_squared double, sample_size int, zone_fallback boolean, model_version string")).first()
    assert (states["n"], states["n_valued"], states["n_fallback"], states["lead_reason"]) == (12, 1, 1, "no_area")


# as-of and ranks ----------------------------------------------------------------------------------------------------


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(400))) for i in range(150)]
    right = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(hours=rng.randrange(400)), i, rng.randrange(99)) for i in range(80)]
    frames = spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, at timestamp, tie int, v int")
    for unit in ("day", "year"):
        got = {r["i"]: (r["tie"], r["v"]) for r in asof.asof_join(*frames, ["k"], "t", "at", "tie", ["tie", "v"], bucket_of=unit).collect()}
        for i, k, at in left:
            best = max(((t, tie, v) for kk, t, tie, v in right if kk == k and k is not None and t <= at), default=(None, None, None))
            if k is not None:
                assert got[i] == best[1:], (unit, i)


def test_rates_and_prices(spark):
    rates = spark.createDataFrame([("EUR", "CZK", dt.date(2026, 8, 1), "24.1"), ("EUR", "CZK", dt.date(2026, 8, 3), "24.5")], "base string, quote string, rate_date date, rate string").withColumn("rate", F.col("rate").cast("decimal(20,10)"))
    asked = spark.createDataFrame([(1, "CZK", dt.date(2026, 8, 2)), (2, "CZK", dt.date(2026, 8, 3)), (3, "CZK", dt.date(2026, 7, 1)), (4, "PLN", dt.date(2026, 8, 3))], "i int, quote string, on_date date")
    got = {r["i"]: (float(r["rate"]) if r["rate"] else None, r["stale"]) for r in asof.rate_for(asked, rates).collect()}
    assert got == {1: (24.1, True), 2: (24.5, False), 3: (None, None), 4: (None, None)}
    history = spark.createDataFrame([(1, 1, day(0), 100), (1, 2, day(10), 80), (1, 3, day(20), 85)], "object_id long, id long, change_at timestamp, price_minor long")
    marks = spark.createDataFrame([(1, T0 - dt.timedelta(hours=1)), (1, day(0)), (1, day(5)), (1, day(12)), (1, day(25))], "object_id long, m timestamp")
    got = [tuple(r)[2:] for r in sorted(asof.price_behaviour(marks, history, "object_id", "m", "change_at", "id", "price_minor").collect(), key=lambda r: r["m"])]
    assert got == [(0, 0.0, 0, 0), (0, 0.0, 0, 0), (0, 0.0, 5, 0), (1, 20.0, 2, 0), (1, 15.0, 5, 1)]


def test_ranks(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(103)], "i int, v int")
    got = {r["i"]: r["rank"] for r in ranks.global_rank(rows.repartition(5), ["v", "i"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((i % 7, i) for i in range(103)), 1)}
    assert {r["decile"]: r["n"] for r in ranks.deciles(spark.range(13), ["id"]).groupBy("decile").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1, 9: 1}
    assert ranks.global_rank(spark.range(0), ["id"]).count() == 0


# merging ------------------------------------------------------------------------------------------------------------


def test_merging(spark):
    base = spark.createDataFrame([(1, "a", {"x": "1"}, None, False), (2, "b", {}, "f", True)], "k int, v string, m map<string,string>, d string, s boolean")
    delta = spark.createDataFrame([(1, None, {"x": "2", "y": "3"}, None, True), (2, "c", None, "g", False), (3, "z", {}, None, False)], base.schema)
    got = {r["k"]: tuple(r)[1:] for r in merging.update_known(base, delta, "k", ["v"], ["d"], "d", ["m"], ["s"]).collect()}
    assert got == {1: ("a", {"x": "2", "y": "3"}, None, True), 2: ("c", {}, "f", True)}
    assert {r["k"]: r["v"] for r in merging.upsert(base, delta, ["k"]).collect()} == {1: None, 2: "c", 3: "z"}
    twice = spark.createDataFrame([(3, "p"), (3, "q"), (1, "r")], "k int, v string")
    assert sorted(tuple(r) for r in merging.insert_absent(base.select("k", "v"), twice, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "b"), (3, "q")]
    same = merging.reconcile({"a": base, "b": twice}, {"a": base, "b": base}).collect()
    assert {r["name"]: r["same"] for r in same} == {"a": True, "b": False}


# matching and zones -------------------------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_keys(spark):
    rng = random.Random(8)
    keys = []
    for _ in range(40):
        word = "".join(rng.choice("abc1") for _ in range(rng.randrange(1, 32)))
        keys.append(word)
        for _ in range(3):
            letters = list(word)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(letters) + 1)
                letters[at:at + rng.randrange(2)] = rng.choice(["", "a", "b"])
            keys.append("".join(letters))
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    for least in (0.9, 0.8):
        got = {(r["a"], r["b"]) for r in matching.similar_keys(frame, "k", least).collect()}
        assert got == {(a, b) for a, b in itertools.combinations(sorted({k for k in keys if k}), 2) if 1 - edit(a, b) / max(len(a), len(b)) >= least - 1e-12}


def test_near_pairs(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-75, 75) if i < 30 else 50 + rng.uniform(0, 0.01), rng.uniform(0, 0.01) + (20 if i < 30 else 14)) for i in range(160)]
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    left, right = (spark.createDataFrame(points, f"{n} int, lat double, lng double") for n in ("listing_id", "object_id"))
    got = {(r["listing_id"], r["object_id"]) for r in matching.near_pairs(left, right, 150.0).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if 1000 * km(a, b) <= 150}


def test_match_cascade(spark):
    objects = [(1, "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0), (2, "CZ", "sale", None, None, "namrepubliky100praha", 2, "byt", None), (3, "CZ", "sale", 50.0, 14.0, "", 4, "byt", 60.0), (4, "CZ", "rent", 50.0, 14.0, "", 3, "byt", 60.0)]
    listings = [(10, "a", "x", "CZ", "sale", None, None, "", None, None, None), (11, "b", "1", "CZ", "sale", 50.0001, 14.0, "", 3, "byt", 62.5), (12, "b", "2", "CZ", "sale", None, None, "namrepubliky10praha", 2, None, None), (13, "b", "3", "CZ", "sale", 50.0, 14.0, "", 3, "byt", 99.0),
                (14, "b", "4", "CZ", "sale", 50.0001, 14.0, "", 3, "byt", 60.0), (15, "a", "9", "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0), (16, "b", "5", "CZ", "sale", None, None, "zcela jinde", 2, None, None)]
    got = matching.match_listings(
        spark.createDataFrame(listings, "listing_id long, source_id string, external_id string, country string, deal_type string, lat double, lng double, address_key string, rooms int, property_type string, area_sqm double"),
        spark.createDataFrame(objects, "object_id long, country string, deal_type string, lat double, lng double, address_key string, rooms int, property_type string, area_sqm double"),
        spark.createDataFrame([("a", "x", 1)], "source_id string, external_id string, object_id long"))
    assert sorted(tuple(r) for r in got.collect()) == [(10, 1, "source_external", "high"), (11, 1, "geo", "high"), (12, 2, "address", "low"), (13, None, "created", "high"), (14, None, "created", "high"), (15, None, "created", "high"), (16, None, "created", "high")]


MARKET_SCHEMA = "country string, deal_type string, lat double, lng double, address_key string, rooms int, property_type string, area_sqm double"


def by_turns(listings, objects, links, radius=50, tolerance=0.1, least=0.9, nearest=20):
    """Each source's listings by id, one after the other."""
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    known = {(s, e): o for s, e, o in links}
    taken, out = {(s, o) for s, _, o in links}, {}
    for i, s, e, country, deal, lat, lng, key, rooms, kind, area in sorted(listings):
        if (s, e) in known:
            out[i] = (known[s, e], "source_external")
            continue
        free = [o for o in objects if o[1:3] == (country, deal) and (s, o[0]) not in taken]
        if lat is not None:
            method, cands = "geo", sorted((1000 * km((lat, lng), o[3:5]), o[0], o) for o in free if o[3] is not None)
            cands = [c for c in cands if c[0] <= radius][:nearest]
        else:
            method, cands = "address", sorted((1 - (1 - edit(key, o[5]) / max(len(key), len(o[5]))), o[0], o) for o in free if o[3] is None and key and o[5]) if key else []
            cands = [c for c in cands if 1 - c[0] >= least - 1e-12]
        fits = lambda o: (rooms is None or o[6] is None or rooms == o[6]) and (kind is None or o[7] is None or kind == o[7]) and (area is None or o[8] is None or abs(area - o[8]) <= tolerance * o[8])
        pick = next((o[0] for _, _, o in cands if fits(o)), None)
        out[i] = (pick, method if pick else "created")
        if pick:
            taken.add((s, pick))
    return out


def test_match_second_choices(spark):
    """Who comes too late for an object takes the next one; on random crowded markets, over several rounds and with more candidates than are looked at."""
    frames = lambda ls, os, ks: (spark.createDataFrame(ls, f"listing_id long, source_id string, external_id string, {MARKET_SCHEMA}"), spark.createDataFrame(os, f"object_id long, {MARKET_SCHEMA}"), spark.createDataFrame(ks, "source_id string, external_id string, object_id long"))
    objects = [(1, "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0), (2, "CZ", "sale", 50.0001, 14.0, "", 3, "byt", 60.0)]
    listings = [(11, "a", "x", "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0), (12, "a", "y", "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0), (13, "a", "z", "CZ", "sale", 50.0, 14.0, "", 3, "byt", 60.0)]
    got = matching.match_listings(*frames(listings, objects, [("q", "q", 99)]))
    assert {r["listing_id"]: (r["object_id"], r["method"]) for r in got.collect()} == {11: (1, "geo"), 12: (2, "geo"), 13: (None, "created")}
    rng = random.Random(5)
    spot = lambda: (50 + rng.randrange(4) * 0.0002, 14 + rng.randrange(3) * 0.0003)
    keys = ["hlavni12praha", "hlavni13praha", "hlavni14praha", "jinde7brno"]
    row = lambda: ("CZ", "sale", *(spot() if rng.random() < 0.8 else (None, None)), rng.choice(keys), rng.choice([1, 2, None]), "byt", rng.choice([50.0, 53.0, 80.0, None]))
    objects = [(i, *row()) for i in range(1, 60)]
    listings = [(100 + i, rng.choice("ab"), str(i), *row()) for i in range(50)]
    links = [("a", "3", 7), ("b", "99", 8), ("a", "98", 9)]
    for nearest in (20, 3):
        got = matching.match_listings(*frames(listings, objects, links), nearest=nearest)
        assert {r["listing_id"]: (r["object_id"], r["method"]) for r in got.collect()} == by_turns(listings, objects, links, nearest=nearest)
    empty = [f.limit(0) for f in frames(listings, objects, links)]
    assert matching.match_listings(*empty).collect() == [] and {r["method"] for r in matching.match_listings(frames(listings, objects, links)[0], *empty[1:]).collect()} == {"created"}


def box(x1, y1, x2, y2):
    return [[{"x": x, "y": y} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]]


def test_zones(spark):
    zones = spark.createDataFrame([(1, "CZ", "region", box(10.0, 45.0, 10.2, 45.2)), (2, "CZ", "municipality", box(10.05, 45.05, 10.10, 45.10)), (3, "CZ", "zone", box(10.06, 45.06, 10.08, 45.08))], "id long, country string, level string, rings array<array<struct<x:double,y:double>>>")
    rows = [(1, 10.07, 45.07, None), (2, 10.055, 45.055, None), (3, 10.01, 45.01, 2), (4, 20.0, 50.0, None), (5, None, None, None)]
    objects = spark.createDataFrame([(i, "CZ", x, y, z, True, False) for i, x, y, z in rows], "id long, country string, lng double, lat double, zone_id long, zone_dirty boolean, zone_terminal boolean")
    after, report = spatial.reassign(objects, zones)
    assert {r["id"]: r["zone_id"] for r in after.collect()} == {1: 3, 2: 2, 3: 1, 4: None, 5: None}
    assert report.first().asDict() == {"with_geom": 4, "no_geom": 1, "changed": 3, "cleared": 0, "uncovered": 1}
    again, report = spatial.reassign(after, zones)
    assert report.first()["changed"] == 0
    moved = after.withColumn("lng", F.when(F.col("id") == 1, 30.0).otherwise(F.col("lng"))).withColumn("zone_dirty", F.col("id") == 1)
    assert spatial.reassign(moved, zones)[1].first()["cleared"] == 1
    assert {r["id"]: r["parent_id"] for r in spatial.link_parents(zones).collect()} == {1: None, 2: 1, 3: 2}
    points = spark.createDataFrame([(x / 7, y / 5) for x in range(8) for y in range(6)], "lng double, lat double").repartition(5)
    hull = [(r["x"], r["y"]) for r in spatial.convex_hull(points).collect()]
    assert sorted(hull) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [r["outside"] for r in spatial.outside_hull(spark.createDataFrame([(0.5, 0.5), (1.5, 0.5)], "lng double, lat double"), hull).collect()] == [False, True]


# delisting ----------------------------------------------------------------------------------------------------------


def test_delisting(spark):
    runs = spark.createDataFrame([(i, 1, T0 + dt.timedelta(hours=i), c) for i, c in enumerate(["complete", "partial", "failed", "complete", "complete"])] + [(9, 2, day(5), "complete")], "run_id int, config_id int, started_at timestamp, completeness string")
    seen = spark.createDataFrame([(1, 0, T0), (2, 4, T0), (3, 1, T0), (4, 0, T0), (4, 3, T0)], "object_id long, run_id int, fetched_at timestamp")
    missed = delisting.misses(runs, seen)
    assert {r["object_id"]: r["misses"] for r in missed.collect()} == {1: 2, 2: 0, 3: 3, 4: 1}
    objects = spark.createDataFrame([(i, "active", None) for i in range(1, 13)], "id long, status string, delisted_reason string")
    after, report = delisting.delist_pass(objects, missed, max_share_pct=50)
    assert {r["id"] for r in after.where("status = 'delisted'").collect()} == {1, 3} and report.first().asDict() == {"candidates": 2, "active": 12, "anomaly": False}
    same, report = delisting.delist_pass(objects, missed, max_share_pct=10)
    assert same.where("status = 'delisted'").count() == 0 and report.first()["anomaly"]
    small, _ = delisting.delist_pass(objects.where("id < 4"), missed, max_share_pct=10)
    assert small.where("status = 'delisted'").count() == 2
    verdicts = spark.createDataFrame([(1, "alive"), (3, "relisted")], "object_id long, verdict string")
    checked, _ = delisting.delist_pass(objects, missed, max_share_pct=50, verdicts=verdicts)
    assert [tuple(r) for r in checked.where("status = 'delisted'").collect()] == [(3, "delisted", "relisted")]
    assert delisting.reactivate(checked, spark.createDataFrame([(3,)], "object_id long")).where("status = 'delisted'").count() == 0
    with pytest.raises(ValueError):
        delisting.delist_pass(objects, missed, least_misses=1)


# rules --------------------------------------------------------------------------------------------------------------


def test_rules(spark):
    template = "id long, country string, attr_key string, pattern_type string, pattern string, value string, status string, confidence double, promoted_at timestamp"
    held = spark.createDataFrame([(1, "CZ", "lift", "literal", "s výtahem", "true", "active", 0.9, None), (2, "CZ", "lift", "literal", "bez výtahu", "false", "active", 0.8, T0), (3, "CZ", "floor", "regex", r"(?P<val>\d+)\. patro", None, "active", 0.7, None), (4, "CZ", "area_sqm", "regex", r"(\d+) m²", None, "active", 0.7, None), (5, "CZ", "lift", "literal", "x", "x", "candidate", 1.0, None), (6, "SK", "lift", "literal", "byt", "x", "active", 1.0, None)], template)
    registry = spark.createDataFrame([("CZ", "floor", 1.0, 20.0), ("CZ", "lift", None, None)], "country string, key string, value_min double, value_max double")
    book = rules.load(held, registry, "CZ")
    assert [r.id for r in book] == [1, 2, 3, 4]
    objects = spark.createDataFrame([(1, "Byt bez výtahu", "s výtahem, 99. patro, 3. patro, sklep 9 m², byt 65 m²"), (2, "S  VÝTAHEM", None), (3, None, "žádný")], "object_id long, title string, description string")
    got = sorted((r["object_id"], r["attr_key"], r["value"], r["rule_id"], r["promoted"]) for r in rules.apply_rules(objects, book, ["lift", "floor", "area_sqm"]).collect())
    assert got == [(1, "area_sqm", "65.0", 4, False), (1, "floor", "3.0", 3, False), (1, "lift", "true", 1, False), (2, "lift", "true", 1, False)]
    assert rules.apply_rules(objects, [], ["lift"]).count() == 0
    with pytest.raises(ValueError):
        rules.Rule(1, "k", "regex", "no group", None, 1.0).group


def test_needed():
    """Every text that a pattern matches holds one of the strings that it needs."""
    assert needed(r"(?P<val>\d+)\. patro") == [". patro"] and needed("a|b c") == ["a", "b c"] and needed("ab?c+d") == ["a"]
    for pattern in ("(?i)abc", r"\d+", "a?b*", "(abc)", "x|", r"\Qa\E", ""):
        assert needed(pattern) is None
    rng = random.Random(11)
    parts = ["vý", "tah", "a", "b+", "c?", "d*", "e{2}", "f{0,1}", "[gh]", "[^i]", r"\d", r"\.", "(?:jk|l)", "(m)", r"\(", "o|", r"\p{L}", "(?=q)q", "[]x]", "(?<n>r)?", ".", "u++", "w+?"]
    letters = "výtahabcdeeefghjklmno(qrx.]uw1"
    seen = 0
    for _ in range(400):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        pattern = pattern.replace("(?<n>", "(?:", 1) if pattern.count("(?<n>") > 1 else pattern
        held = needed(pattern)
        try:
            compiled = regex.compile(pattern)
        except regex.error:
            continue
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(12))
            if held and compiled.search(text):
                seen += 1
                assert any(h in text for h in held), (pattern, held, text)
    assert seen > 500


def first_hits(objects, book, keys):
    """Rule by rule, text by text."""
    number = lambda s: areas.number(s.replace(" ", ""))
    out = []
    for i, *texts in objects:
        plain = [" ".join(re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower())).strip() for t in texts]
        for key in keys:
            for r in book:
                value = None
                for t in plain:
                    if r.key != key or value is not None:
                        continue
                    if r.kind == "literal":
                        phrase = " ".join(r.pattern.lower().split())
                        value = r.value if phrase and regex.search(rf"(?<![\p{{L}}\p{{Nd}}]){regex.escape(phrase)}(?![\p{{L}}\p{{Nd}}])", t) else None
                    elif r.value is not None:
                        value = r.value if regex.search(r.java, t) else None
                    else:
                        found = [number(m[r.group]) for m in regex.finditer(r.java, t)]
                        value = next((str(n) for n in found if n is not None and (r.low is None or n >= r.low) and (r.high is None or n <= r.high)), None)
                if value is not None:
                    out.append((i, key, value, r.id))
                    break
    return sorted(out)


def test_many_rules(spark):
    """Thousands of rules give what each of them would give on its own."""
    docs = [(r["doc_id"], r["text"][:40], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0").collect()] + [(10**6, None, None), (10**6 + 1, "", "Byt, 3. patro z 12; lift: ano"), (10**6 + 2, "lift:ano", "xlift lifty")]
    rng = random.Random(3)
    words = sorted({w for _, _, t in docs if t for w in re.findall(r"[^\W\d]{3,}", t)})
    book = [rules.Rule(i, rng.choice("abcdef"), "literal", rng.choice(words) + (" " + rng.choice(words) if i % 3 == 0 else ""), rng.choice(["x", "y", None]), 0.5) for i in range(1, 4500)]
    book += [rules.Rule(i, rng.choice("abcg"), "regex", rng.choice([r"{}s? ", r"{}(?:,|\.) ", r"^{}", r"{}|{}"]).format(rng.choice(words).lower(), rng.choice(words).lower()), "z", 0.4) for i in range(4500, 4990)]
    book += [rules.Rule(4990, "n", "regex", r"(?P<val>\d+)\. patro", None, 0.3, 1, 10), rules.Rule(4991, "n", "regex", r"z (\d+)", None, 0.3), rules.Rule(4992, "l", "literal", "LIFT", "true", 0.3), rules.Rule(4993, "q", "regex", r"[qxž]{2}", "w", 0.3), rules.Rule(4994, "a", "literal", "", "no", 0.1)]
    rng.shuffle(book)
    keys = [*"abcdefglnq"]
    got = rules.apply_rules(spark.createDataFrame(docs, "object_id long, title string, description string"), book, keys)
    found = sorted((r["object_id"], r["attr_key"], r["value"], r["rule_id"]) for r in got.collect())
    assert found == first_hits(docs, book, keys) and len(found) > 100


def test_replay(spark):
    """Only the paired objects count; dynamic patterns keep their bounds; what holds on both confirmations is promoted."""
    book = spark.createDataFrame([("CZ", "lift", "Má výtah", "true", "literal", None, None), ("CZ", "floor", r"(?P<val>\d+)\. patro", None, "regex", 1.0, 10.0), ("SK", "lift", "má výtah", "ano", "literal", None, None), ("CZ", "lift", "  ", "x", "literal", None, None), ("CZ", "energy", "třída [ab]", "low", "regex", None, None)],
                                "country string, attr_key string, pattern string, value string, pattern_type string, value_min double, value_max double")
    objects = spark.createDataFrame([(1, "Byt", "dům MÁ  výtah, 99. patro, 3. patro"), (2, None, "nemá výtah; třída B"), (3, "má výtah", None)], "object_id long, title string, description string")
    pairs = book.select("country", "attr_key", "pattern").crossJoin(spark.createDataFrame([(1,), (2,), (9,)], "object_id long"))
    got = sorted(map(tuple, rules.replay(book, objects, pairs.union(pairs)).collect()))
    assert got == [("CZ", "energy", "třída [ab]", 2, "low"), ("CZ", "floor", r"(?P<val>\d+)\. patro", 1, "3.0"), ("CZ", "lift", "Má výtah", 1, "true"), ("SK", "lift", "má výtah", 1, "ano")]
    kind = "country string, attr_key string, pattern string, value string, status string, occurrences long, conflicts long, last_ids array<long>, promoted_at timestamp"
    table = spark.createDataFrame([("CZ", "lift", "má výtah", "true", "candidate", 5, 0, [1, 3], None), ("CZ", "lift", "výtah", "true", "candidate", 5, 0, [1, 2], None), ("CZ", "lift", "dům", "true", "candidate", 4, 0, [1, 3], None), ("CZ", "lift", "byt", "true", "active", 9, 0, [1, 1], T0)], kind)
    current = spark.createDataFrame([(1, "lift", "true"), (2, "lift", "false"), (3, "lift", "true")], "object_id long, attr_key string, value string")
    after = {r["pattern"]: (r["status"], r["promoted_at"]) for r in rules.promoted(table, objects, current, F.lit(T0)).collect()}
    assert after == {"má výtah": ("active", T0), "výtah": ("candidate", None), "dům": ("candidate", None), "byt": ("active", T0)}


def test_template_life(spark):
    kind = "country string, attr_key string, pattern string, value string, status string, confidence double, occurrences long, conflicts long, example_object_ids array<long>, last_ids array<long>"
    held = spark.createDataFrame([("CZ", "lift", "má výtah", "true", "candidate", 0.9, 4, 0, [1, 2, 3, 4], [3, 4]), ("CZ", "lift", "old", "true", "active", 0.5, 1, 0, [1], [1])], kind)
    said = lambda seq, pattern, value, oid, confidence=0.8: (seq, "CZ", "lift", pattern, f"dům {pattern} je", f"Pěkný dům {pattern} je tu", value, confidence, oid)
    events = spark.createDataFrame([said(1, "má výtah", "true", 9), said(2, "má výtah", "true", 4), said(3, "je nový", "true", 5), said(4, "je nový", "false", 6), said(5, "je nový", "true", 5), said(6, "x1", "true", 7), said(7, "bez ceny", "true", 7, 0.0)], "seq int, country string, attr_key string, pattern string, quote string, text string, value string, confidence double, object_id long")
    got = {r["pattern"]: r for r in rules.mine(held, events).collect()}
    assert set(got) == {"má výtah", "old", "je nový"}
    r = got["má výtah"]
    assert (r["occurrences"], r["conflicts"], r["status"], r["confidence"], r["example_object_ids"], r["last_ids"]) == (5, 0, "candidate", 0.8, [1, 2, 3, 4, 9], [4, 9])
    r = got["je nový"]
    assert (r["occurrences"], r["conflicts"], r["status"], r["value"], r["example_object_ids"], r["last_ids"]) == (1, 1, "conflict", "true", [5, 6], [5])
    fired = spark.createDataFrame([("lift", "má výtah", 4, "true"), ("lift", "má výtah", 9, "true")], "attr_key string, pattern string, object_id long, value string")
    current = spark.createDataFrame([(4, "lift", "true"), (9, "lift", "true")], "object_id long, attr_key string, value string")
    table = rules.mine(held, events)
    assert [r["pattern"] for r in rules.promotable(table, fired, current).collect()] == ["má výtah"]
    assert rules.promotable(table, fired.where("object_id = 4"), current).count() == 0 and rules.promotable(table, fired, current, 0).count() == 0
    templates = spark.createDataFrame([(1, "active", 0), (2, "active", 0), (3, "conflict", 0)], "id long, status string, shadow_mismatches long")
    checks = spark.createDataFrame([(1, 7, "lift", "true", "pending", None), (2, 7, "lift", "true", "pending", None), (3, 7, "lift", "x", "pending", None), (1, 8, "lift", "true", "done", "true")], "template_id long, object_id long, attr_key string, template_value string, status string, llm_value string")
    verdicts = spark.createDataFrame([(1, 7, "lift", "true"), (2, 7, "lift", "false"), (3, 7, "lift", "y")], "template_id long, object_id long, attr_key string, llm_value string")
    after, settled = rules.settle_shadow(templates, checks, verdicts)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "active", 0), (2, "demoted", 1), (3, "conflict", 1)]
    assert sorted((r["template_id"], r["object_id"], r["status"]) for r in settled.collect()) == [(1, 7, "done"), (1, 8, "done"), (2, 7, "mismatch"), (3, 7, "mismatch")]


# schedules and queues -----------------------------------------------------------------------------------------------


def test_schedule(spark):
    outcomes = spark.createDataFrame([("s", T0 + dt.timedelta(hours=i), ok) for i, ok in enumerate([False, False, False, True, True, False])], "source_id string, at timestamp, ok boolean")
    got = [(r["strikes"], r["rate_factor"], r["cooldown_minutes"]) for r in scheduling.cooldown_ladder(outcomes).orderBy("at").collect()]
    assert got == [(1, 0.5, 60.0), (2, 0.25, 120.0), (3, 0.25, 240.0), (0, 0.375, 0.0), (0, 0.5625, 0.0), (1, 0.28125, 60.0)]
    noon = dt.datetime(2026, 8, 3, 12, 30)  # a Monday
    sources = spark.createDataFrame([("a", "active", 1.0, None), ("b", "cooldown", 0.5, noon), ("c", "blocked", 1.0, None), ("d", "active", 1.0, None)], "source_id string, state string, rate_factor double, cooldown_until timestamp")
    windows = spark.createDataFrame([(s, 1, 1, 8, 18, 4) for s in "abcd"] + [("a", 2, 1, 12, 13, 3), ("d", 2, 2, 8, 18, 9)], "source_id string, window_id int, day_of_week int, hour_start int, hour_end int, max_requests_per_hour int")
    runs = spark.createDataFrame([("a", 1, noon - dt.timedelta(minutes=9), "complete", 3)] + [("d", 4, noon - dt.timedelta(minutes=i), "complete", 0) for i in range(4)], "source_id string, config_id int, started_at timestamp, completeness string, new_objects long")
    configs = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 3, True), ("d", 4, True), ("a", 0, False)], "source_id string, config_id int, active boolean")
    weighted = scheduling.window_weights(windows, scheduling.slot_yields(runs), dt.date(2026, 8, 3), least_scans=0)
    got = [tuple(r) for r in scheduling.plan(sources, weighted, configs, runs, noon).collect()]
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [("a", 2, "1-12", 2), ("b", 3, "1-12", 2)]
    assert got[0][3] == 1.0 and got[1][3] == pytest.approx(0.1)
    assert [tuple(r) for r in scheduling.overlapping_windows(windows).collect()] == [("a", 1, 1, 2)]


def test_queues(spark):
    rows = spark.createDataFrame([(i, "k", T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 30, 59, 60, 100, 121])], "id int, k string, t timestamp")
    assert sorted(r["id"] for r in queues.without_repeats(rows, ["k"], "t", "id", 3600).collect()) == [0, 3, 5]
    queue = spark.createDataFrame([("prod", "pending", "x", T0), ("prod", "sent", "queue_depth", T0 + dt.timedelta(minutes=30)), ("test", "pending", "x", T0)], "queue_ns string, status string, kind string, created_at timestamp")
    assert queues.depth_alert(queue, T0 + dt.timedelta(minutes=60)).count() == 0
    assert queues.depth_alert(queue, T0 + dt.timedelta(minutes=95)).first().asDict() == {"pending_total": 1, "pending_older": 1, "oldest_minutes": 95}
    tasks = spark.createDataFrame([(i, 10) for i in range(9)], "id int, c int")
    assert sorted(r["id"] for r in queues.within_budget(tasks, ["id"], "c", 25).collect()) == [0, 1, 2]
    due = spark.createDataFrame([("b.cz", "pending", None), ("a.cz", "pending", T0), ("c.cz", "direct", None), ("z.cz", "pending", None)], "domain string, class string, probed_at timestamp")
    assert [r["domain"] for r in queues.due_candidates(due, T0 + dt.timedelta(minutes=30), pinned=["z.cz"]).collect()] == ["z.cz", "b.cz"]
    seen = spark.createDataFrame([("dead", "dead", None, 90), ("dead", None, None, None), ("dead", "dead", None, 10), ("direct", None, None, None), (None, None, None, None)], "o string, p string, r string, m int")
    assert [r[0] for r in seen.select(queues.confirmed_class("o", "p", "r", "m", ["dead"])).collect()] == ["dead", "pending", "pending", "direct", "pending"]


def test_quality(spark):
    objects = spark.createDataFrame([(1, 1, "CZ", "CZ", "active", 50.0, 2, "private", {"area_sqm": "50", "rooms": "2", "seller_type": "private"}, "street", T0, T0), (2, 2, "CZ", "CZ", "active", 40.0, None, None, {"area_sqm": "41", "rooms": "1"}, None, None, T0)],
                                    "id long, object_id long, country string, property_country string, status string, area_sqm double, rooms int, seller_type string, attributes map<string,string>, geo_confidence string, detail_fetched_at timestamp, first_seen_at timestamp")
    sources = spark.createDataFrame([("s", "active"), ("t", "blocked")], "source_id string, state string")
    configs = spark.createDataFrame([("s", True)], "source_id string, active boolean")
    runs = spark.createDataFrame([("s", day(2))], "source_id string, started_at timestamp")
    queue = spark.createDataFrame([("pending", T0)], "status string, created_at timestamp")
    values = spark.createDataFrame([(0.1, None), (None, "no_area"), (None, None)], "price_deviation double, deviation_null_reason string")
    got = {r["name"]: r["status"] for r in quality.invariants(objects, sources, configs, runs, queue, values, day(3)).collect()}
    assert got == {"corpus": "INFO", "mirrors:area_sqm": "FAIL", "mirrors:rooms": "FAIL", "mirrors:seller_type": "OK", "not_modeled": "FAIL", "lost": "FAIL", "schedule:s": "OK", "schedule:t": "INFO", "blocked:s": "OK", "blocked:t": "FAIL", "notifs": "FAIL", "valuations": "FAIL"}
    registry = spark.createDataFrame([("CZ", "rooms"), ("CZ", "lift")], "country string, key string")
    ways = spark.createDataFrame([(1, "rooms", "rule_text", 0.9), (2, "rooms", "llm_extraction", 0.3)], "object_id long, attr_key string, extracted_by string, confidence double")
    got = {r["attr_key"]: (r["n_objects"], r["rule_text"], r["llm_extraction"], r["missing"]) for r in quality.coverage_by_method(objects, registry, ways).collect()}
    assert got == {"rooms": (2, 1, 1, 0), "lift": (2, 0, 0, 2)}
    kept = {r["id"]: sorted(r["attributes"]) for r in quality.without_low_confidence(objects, ways).collect()}
    assert kept == {1: ["area_sqm", "rooms", "seller_type"], 2: ["area_sqm"]}
    assert sorted((r["object_id"], r["attr_key"]) for r in rules.missing_attributes(objects, registry, ways.where("object_id = 0")).collect()) == [(1, "lift"), (2, "lift")]


# probing and extraction ---------------------------------------------------------------------------------------------


def test_probing(spark):
    from hearthline.operators import probing

    rows = spark.createDataFrame([("http://s.cz/12345-a", "Prodej bytu 2+kk, 54 m², 5 000 000 Kč, Praha 150 00, majitel, 1.2.2026 {\"lat\": 50.1, \"lng\": 14.2}"), ("", "Pronájem domu, cena na dotaz"), (None, None)], "url string, html string")
    cover = probing.field_coverage(probing.field_sample(rows)).first().asDict()
    assert cover == {"n": 3, "external_id": 1, "url": 1, "price": 2, "deal_type": 2, "property_type": 1, "area": 1, "layout": 1, "location": 1, "position": 1, "seller": 1, "date": 1}
    links = ["http://s.cz/prodej/byt", "http://s.cz/inzerat/5/byt", "http://s.cz/blog/byt", "http://s.cz/x.css", "http://other.cz/prodej", "http://www.s.cz/vypis/nemovitosti", "http://s.cz/o-nas", "http://s.cz/prodej/byt", "http://s.cz/prodej/dum"]
    frame = spark.createDataFrame([(1, "s.cz", u, i) for i, u in enumerate(links)], "page_id int, site string, link string, pos int")
    assert [r["link"] for r in probing.best_links(frame, 2).orderBy(F.desc("score"), "pos").collect()] == [links[5], links[0]]
    cover = lambda n, k: {"n": n, "external_id": k, "url": k, "price": k, "deal_type": k, "property_type": k}
    cases = [("blocked", "", "a.cz", cover(0, 0), "blocked"), ("pending", "ceskereality " * 5, "a.cz", cover(30, 30), "mirror"), (None, "RE/MAX", "a.cz", cover(30, 30), "agency_site"), (None, "", "a.sk", cover(30, 30), "excluded_no_data"), (None, "", "a.cz", cover(30, 30), "direct"), (None, "", "a.cz", cover(29, 29), "excluded_no_data"), (None, None, "a.cz", cover(30, 29), "excluded_no_data")]
    frame = spark.createDataFrame([c[:4] for c in cases], "o string, h string, d string, c struct<n:int,external_id:int,url:int,price:int,deal_type:int,property_type:int>")
    assert [r[0] for r in frame.select(probing.probe_class(F.col("o"), F.col("h"), F.col("d"), F.col("c"))).collect()] == [c[4] for c in cases]
    waits = spark.createDataFrame([("120",), ("Mon, 03 Aug 2026 00:00:30 GMT",), ("Sat, 01 Aug 2020 00:00:00 GMT",), ("soon",)], "h string")
    assert [r[0] for r in waits.select(probing.retry_seconds(F.col("h"), F.lit("2026-08-03").cast("timestamp"))).collect()] == [120, 30, 0, None]
    cache = spark.createDataFrame([("a|b", True, 1.0, 2.0), ("c", False, None, None)], "query_norm string, hit boolean, lat double, lng double")
    asked = spark.createDataFrame([("a|b",), ("c",), ("d",), ("",)], "query_norm string")
    found, missing = probing.cached_answers(asked, cache)
    assert {r["query_norm"]: r["hit"] for r in found.collect()} == {"a|b": True, "c": False, "d": None, "": None} and [r[0] for r in missing.collect()] == ["d"]


def test_extraction(spark):
    from hearthline.operators import extraction

    answers = spark.createDataFrame([(1, '<think>{x}</think> ```json\n{"rooms": {"value": 3, "confidence": 0.95}, "lift": {"value": "TRUE", "confidence": 0.5}, "state": {"value": "Good", "confidence": 0.5}, "odd": {"value": 1, "confidence": 1}, "area_sqm": {"value": 90, "confidence": 1}}\n```', {"total_area": "80"}),
                                     (2, '{"total_area": {"value": 60, "confidence": 1, "quote": "užitná plocha 60"}, "rooms": {"value": 2.5, "confidence": 1}, "lift": {"value": true, "confidence": 2}, "state": {"value": null, "confidence": 1}}', {}), (3, "no answer", {})], "object_id long, answer string, attributes map<string,string>")
    registry = spark.createDataFrame([("rooms", "int", None, 1.0, 9.0), ("lift", "bool", None, None, None), ("state", "enum", ["good", "bad"], None, None), ("area_sqm", "float", None, None, None), ("total_area", "float", None, None, None)], "key string, data_type string, allowed_values array<string>, value_min double, value_max double")
    good, bad = extraction.attributes_of(answers, registry)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "lift", "true", 0.5), (1, "rooms", "3", 0.9), (1, "state", "good", 0.5)]
    assert sorted(tuple(r) for r in bad.collect()) == [(1, "area_sqm", "area_over_total"), (1, "odd", "unknown_key"), (2, "lift", "bad_confidence"), (2, "rooms", "not_int"), (2, "state", "no_value"), (2, "total_area", "living_area")]
    raw = spark.createDataFrame([('{"a": true, "b": 3.50, "c": 4, "d": "x0"}',)], "j string")
    assert raw.select(extraction.normalised_attributes(F.col("j"))).first()[0] == {"a": "true", "b": "3.5", "c": "4", "d": "x0"}
    pairs = spark.createDataFrame([("1", "1.0"), ("true", '"true"'), ('"1"', "1"), ('"a"', ' "a"'), ("true", "true")], "a string, b string")
    assert [r[0] for r in pairs.select(extraction.same_json(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]
    objects = spark.createDataFrame([(1, 50.0, 14.0, "old", 5.0, {"a": "1"}, "h0", None, False, True), (2, 50.0, 14.0, "keep", 6.0, {}, None, None, False, True), (3, None, None, None, None, {}, None, None, False, True)], "id long, lat double, lng double, address string, area_sqm double, attributes map<string,string>, detail_hash string, detail_fetched_at timestamp, zone_dirty boolean, zone_terminal boolean")
    details = spark.createDataFrame([(1, 50.1, 14.0, "new", None, {"a": "2", "b": "3"}, "h1"), (2, 50.0, 14.0, "", 7.0, None, "h2")], "id long, lat double, lng double, address string, area_sqm double, attributes map<string,string>, detail_hash string")
    got = {r["id"]: tuple(r)[1:] for r in extraction.merge_details(objects, details, F.lit("2026-08-01").cast("timestamp")).collect()}
    assert got == {1: (50.1, 14.0, "new", 5.0, {"a": "2", "b": "3"}, "h1", T0, True, False), 2: (50.0, 14.0, "keep", 7.0, {}, "h2", T0, False, True), 3: (None, None, None, None, {}, None, None, False, True)}


def test_settings_and_schemas(spark):
    from hearthline.settings import Thresholds
    from hearthline.sources import schemas

    assert Thresholds().delist_misses == 2
    for wrong in ({"dedupe_similarity": 1.5}, {"delist_misses": 1}, {"map_points": -1}):
        with pytest.raises(ValueError):
            Thresholds(**wrong)
    assert all(schemas.schema(name).fields for name in schemas.SCHEMAS)
    assert spark.createDataFrame([], schemas.schema("objects")).count() == 0


# pairs, carried values, configurations, model history ---------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similar_keys_against_brute_force(spark):
    """Short and long keys, many of one stem, a pair of each kind over the border between the two ways of indexing."""
    import random

    from hearthline.operators import matching

    rng = random.Random(3)
    keys = [f"customer{n:09d}" for n in range(60)] + ["a", "b", "ab", "abc", ""]
    for size in (9, 10, 11, 28, 29, 30, 31, 45):
        for _ in range(6):
            base = [rng.choice("abcd") for _ in range(size)]
            for edits in (0, 1, 2, 3, 5):
                word = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(word))
                    kind = rng.randrange(3)
                    word[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcd")]
                keys.append("".join(word))
    frame = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string").repartition(3)
    got = {(r["a"], r["b"]) for r in matching.similar_keys(frame, "k", 0.9).collect()}
    own = sorted({k for k in keys if k})
    assert got == {(a, b) for i, a in enumerate(own) for b in own[i + 1:] if 1 - plain_distance(a, b) / max(len(a), len(b)) >= 0.9 - 1e-12}


def test_with_previous(spark):
    """Over bucket borders, with null values and null keys, as one window would give it."""
    import datetime as dt

    from pyspark.sql import Window

    from hearthline.operators import asof

    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=13 * i), i, None if i % 5 == 0 else i * 7 % 11) for k in ("a", "b", None) for i in range(20)]
    frame = spark.createDataFrame(rows, "k string, at timestamp, id int, v int").repartition(4)
    whole = frame.select("k", "id", F.lag("v").over(Window.partitionBy("k").orderBy("at", "id")).alias("previous"))
    got = asof.with_previous(frame, ["k"], "at", "id", "v").select("k", "id", "previous")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_search_configs_and_payloads(spark):
    import datetime as dt

    from hearthline.operators import configs

    problems = spark.createDataFrame([("sale", 1, 2, 1.0, 2.0, "EUR"), ("lease", 1, 2, None, None, "EUR"), (None, None, None, None, None, None), ("rent", 3, 2, None, None, "EUR"), ("rent", None, None, 3.0, 2.0, None), ("rent", -1, None, None, None, "EUR"), ("rent", 1, None, None, None, None), ("auction", None, None, None, None, None)], "d string, a long, b long, c double, e double, f string")
    assert [r[0] for r in problems.select(configs.config_problem(*[F.col(c) for c in "dabcef"])).collect()] == [None, "bad_deal_type", "bad_deal_type", "price_min_over_max", "area_min_over_max", "negative_bound", "price_without_currency", None]
    once = configs.retired(spark.createDataFrame([(1, True, dt.datetime(2024, 1, 1)), (2, False, dt.datetime(2024, 1, 1))], "id long, active boolean, updated_at timestamp"), spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long"), dt.datetime(2024, 2, 1))
    assert sorted(map(tuple, once.collect())) == [(1, False, dt.datetime(2024, 2, 1)), (2, False, dt.datetime(2024, 1, 1))]
    said = spark.createDataFrame([("price_drop", {"object_id": "1", "old_price": "", "x": "y"}), ("price_drop", {"object_id": "1", "old_price": "2", "new_price": "1"}), ("other", {})], "k string, p map<string,string>")
    assert [r[0] for r in said.select(configs.missing_keys(F.col("k"), F.col("p"))).collect()] == [["old_price", "new_price"], [], None]


def test_model_history(spark):
    from hearthline.operators import survival

    schema = "country string, deal_type string, model_version string, status string, reject_reason string, n_completed_events long, n_person_periods long, max_calib_dev double, brier_score double, c_index double, computed_at timestamp"
    history = spark.createDataFrame([], schema)
    for day, status in (("2024-01-01", "insufficient_history"), ("2024-02-01", "published"), ("2024-03-01", "published"), ("2025-04-01", "uncalibrated")):
        history = survival.with_run(history, survival.Report(status=status, completed=3, n_train=4, n_test=1, brier=0.2), "CZ", "sale", "v" + day, F.lit(day))
    assert history.count() == 4 and {(r["n_completed_events"], r["n_person_periods"], r["brier_score"], r["c_index"]) for r in history.collect()} == {(3, 5, 0.2, None)}
    due = survival.transitions(history).orderBy("computed_at").collect()
    assert [(r["before"], r["status"]) for r in due] == [("insufficient_history", "published"), ("published", "uncalibrated")]


def test_trigram_index(spark, tmp_path, market):
    """Finds what a scan finds, also after rows were added again, and reads the partitions of the rarest trigrams only."""
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 0 else "".join(rng.choice("abcčŽ ") for _ in range(rng.randrange(12)))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, address string")
    index = TrigramIndex(spark, str(tmp_path / "i"), frame.schema["id"].dataType, 16)
    index.add(frame.where("id < 400"), "id", "address")
    index.add(frame.where("id >= 300"), "id", "address")
    for term in ["abc", "ABCA", "čž ", "a", "", "zzzz", "cab ca", "Ž"]:
        assert sorted(r["id"] for r in index.search(frame, "id", "address", term).collect()) == [i for i, a in rows if a is not None and term.lower() in a.lower()]
    with pytest.raises(ValueError):
        index.candidates("ab")
    plan = index.candidates("abca", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    objects, values, photos = market
    index = TrigramIndex(spark, str(tmp_path / "j"), objects.schema["id"].dataType, 16)
    index.add(objects, "id", "address")
    for q in ("special 1", "ecial 7", "cia", "sp", "nothing"):
        pages = [catalog.list_objects(objects, values, photos, {"q": q}, by) for by in (None, index)]
        assert [r["id"] for r in pages[0][0].collect()] == [r["id"] for r in pages[1][0].collect()] and pages[0][1].first() == pages[1][1].first()


def test_matching_windows_and_dates(spark):
    """Overlapping windows give the greatest weight and the least cap; a later date of posting shows against earlier sightings only, across buckets and for null keys."""
    windows = spark.createDataFrame([(1, 6, 8, 12, 3, 10), (1, 6, 11, 18, 5, 6), (2, 6, 0, 24, 1, 1)], "source_id int, day_of_week int, hour_start int, hour_end int, weight int, cap int")
    moments = spark.createDataFrame([(i, s, dt.datetime(2026, 8, 1, h)) for i, (s, h) in enumerate([(1, 8), (1, 11), (1, 18), (2, 3), (3, 3), (1, 12)])], "i int, source_id int, at timestamp")
    assert sorted((r["i"], r["weight"], r["cap"]) for r in scheduling.matching_windows(moments, windows, "at").collect()) == [(0, 3, 10), (1, 5, 6), (3, 1, 1), (5, 5, 6)]
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(8)])) for i in range(300)]
    got = {r["n"]: r["moved_forward"] for r in delisting.moved_forward(spark.createDataFrame(rows, "k string, n long, posted int"), ["k"], "n", "posted").collect()}
    assert got == {n: p is not None and any(q is not None and q < p for j, m, q in rows if j == k and m < n) for k, n, p in rows}
    least = {r["n"]: r["m"] for r in ranks.least_before(spark.createDataFrame(rows, "k string, n long, posted int"), ["k"], "n", "posted", "m", 7).collect()}
    assert least == {n: min((q for j, m, q in rows if j == k and m < n and q is not None), default=None) for k, n, p in rows}


def test_exact_median(spark):
    """One group with most rows, ties, an even and an odd number, one value, none; nulls and NaN don't count; over several rounds of bins."""
    rng = random.Random(6)
    rows = [("big", rng.choice([rng.uniform(0, 1), rng.uniform(0, 1e9), 7.0])) for _ in range(4001)] + [("even", float(i)) for i in range(10)] + [("ties", v) for v in [5.0] * 900 + [1.0, 9.0]] + [("one", -3.0), ("none", None), ("none", float("nan")), (None, 2.0), (None, 4.0), ("skew", 1e12)] + [("skew", i / 1e6) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, v double")
    want = {k: statistics.median(v for j, v in rows if j == k and v is not None and v == v) for k in {k for k, _ in rows} - {"none"}}
    for bins, few in ((8, 5), (1024, 4096), (2, 1)):
        got = {r["k"]: r["median"] for r in exact_median(frame, ["k"], "v", bins=bins, few=few).collect()}
        assert got == pytest.approx(want, rel=1e-15)
    assert exact_median(frame.limit(0), ["k"], "v").collect() == []


def test_zones_by_cells(spark):
    """Cells inside a zone settle points without a test, border cells test them; a hole, a triangle, several countries."""
    rng = random.Random(12)
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in [*p, p[0]]]
    shapes = [(1, "CZ", "region", [ring((0, 0), (3, 0), (3, 3), (0, 3)), ring((1, 1), (2, 1), (2, 2), (1, 2))]), (2, "CZ", "zone", [ring((0.5, 0.2), (2.7, 0.4), (1.1, 2.9))]), (3, "SK", "zone", [ring((0, 0), (3, 0), (3, 3), (0, 3))]), (4, "CZ", "municipality", [ring((2.95, 2.95), (2.96, 2.95), (2.96, 2.96))])]
    kind = "id long, country string, level string, rings array<array<struct<x:double,y:double>>>"
    rows = [(i, rng.choice(["CZ", "SK"]), rng.uniform(-0.5, 3.5), rng.uniform(-0.5, 3.5)) for i in range(400)] + [(900, "CZ", 2.957, 2.952), (901, "CZ", None, 1.0)]
    points = spark.createDataFrame(rows, "id long, country string, lng double, lat double")
    cross = lambda x, y, r: sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for a, b in zip(r, r[1:])) % 2 == 1
    want = {(i, z) for i, c, x, y in rows if x is not None for z, country, _, rings in shapes if c == country and cross(x, y, rings[0]) and not any(cross(x, y, h) for h in rings[1:])}
    for size in (0.1, 0.5, 10.0):
        assert {(r["id"], r["zone_id"]) for r in spatial.covering_pairs(points, spark.createDataFrame(shapes, kind), "id", size).collect()} == want
    assert (900, 4) in want


def test_touched_by_zones(spark):
    """After zones changed, re-assigning what lies in their cells gives what re-assigning all gives, and looks at no other objects."""
    rng = random.Random(13)
    old = [(i, "CZ", "zone", box(i * 1.0, 0.0, i + 0.9, 1.0)) for i in range(6)] + [(7, "SK", "zone", box(0, 0, 6, 1))]
    new = [z for z in old if z[0] not in (1, 3)] + [(3, "CZ", "zone", box(3.0, 0.0, 3.4, 0.5)), (8, "CZ", "zone", box(5.5, 2.0, 5.9, 2.5))]
    kind = "id long, country string, level string, rings array<array<struct<x:double,y:double>>>"
    before, after = (spark.createDataFrame([(i, c, lv, [[{k: float(v) for k, v in p.items()} for p in r] for r in rings]) for i, c, lv, rings in z], kind) for z in (old, new))
    rows = [(i, rng.choice(["CZ", "SK"]), rng.uniform(0, 6), rng.uniform(0, 2.6), None, False, False) for i in range(300)] + [(500, "CZ", None, None, None, False, False)]
    objects = spark.createDataFrame(rows, "id long, country string, lng double, lat double, zone_id long, zone_dirty boolean, zone_terminal boolean")
    held, _ = spatial.reassign(objects, before)
    held = held.where("zone_id is not null or lat is null")
    marked = spatial.touched_by_zones(held, spatial.cell_index(held), before, after)
    assert marked.columns == held.columns
    dirty = {r["id"] for r in marked.where("zone_dirty").collect()}
    assert 0 < len(dirty) < held.count() / 2
    assert not dirty & {r["id"] for r in held.where("country = 'SK' or (lng < 0.9 or lng between 2.1 and 2.9)").collect()}
    full, _ = spatial.reassign(held.withColumn("zone_dirty", F.lit(True)), after)
    assert {r["id"]: r["zone_id"] for r in spatial.reassign(marked, after)[0].collect()} == {r["id"]: r["zone_id"] for r in full.collect()}


def test_dissolved(spark):
    """Unions of squares of a grid against the cells that they cover: holes, corners that touch, edges of unequal length, several groups; the hull of a union."""
    rng = random.Random(21)
    square = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
    rows, cells = [], {}
    for g in range(6):
        held = {(x, y) for x in range(6) for y in range(6) if rng.random() < 0.6}
        cells[g] = set(held)
        while held:
            x, y = min(held)
            w = 2 if (x + 1, y) in held and rng.random() < 0.5 else 1
            ring = square(x, y, w, 1)
            rows.append((g, [ring if rng.random() < 0.5 else ring[::-1]]))
            held -= {(x + i, y) for i in range(w)}
    rows.append((9, [square(0, 0, 3, 3), square(1, 1, 1, 1)]))
    cells[9] = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    got = {r["g"]: r["polygons"] for r in spatial.dissolved(spark.createDataFrame(rows, "g int, rings array<array<struct<x:double,y:double>>>"), "g", 1.0).collect()}
    crossed = lambda x, y, ring: sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for a, b in zip(ring, ring[1:])) % 2
    for g, polygons in got.items():
        inside = {(x, y) for x in range(7) for y in range(7) if any(crossed(x + 0.5, y + 0.5, p[0]) and not any(crossed(x + 0.5, y + 0.5, h) for h in p[1:]) for p in polygons)}
        assert inside == cells[g]
        area = sum(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:])) / 2 for p in polygons for ring in p)
        assert area == len(cells[g])
        seen, parts = set(), 0
        for c in cells[g]:
            parts, todo = parts + (c not in seen), [c]
            while todo:
                x, y = todo.pop()
                if (x, y) in cells[g] and (x, y) not in seen:
                    seen.add((x, y))
                    todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        assert len(polygons) == parts
    assert len(got) == 7 and len(got[9][0]) == 2
    points = spark.createDataFrame([(p["x"], p["y"]) for p in got[9][0][0]], "lng double, lat double")
    assert sorted((r["x"], r["y"]) for r in spatial.convex_hull(points).collect()) == [(0, 0), (0, 3), (3, 0), (3, 3)]
