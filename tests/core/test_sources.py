"""Parsers of pages and feeds on small samples."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearthline.sources import feeds, paged, pages, tables

CARD = '<div class="inzeraty inzeratyflex"><a href="/inzerat/{id}/byt.php">x</a> [{date}] {price}<div class="inzeratylok">Praha 5<br>152 00</div><div class="popis">Hezký <b>byt</b> &amp; sklep</div></div>'
PRICED = '<div class="inzeratycena"><b>14 500 000 Kč</b></div>'


def test_cards(spark):
    said = lambda s: f'<div class="inzeratycena">{s}</div>'
    cards = [CARD.format(id=1, date="27.8. 2026", price=PRICED), CARD.format(id=2, date="1.1. 2026", price=said("Dohodou")), CARD.format(id=3, date="1.1. 2026", price=said("Zítra")), CARD.format(id=4, date="31.2. 2026", price=PRICED), CARD.format(id=5, date="1.1. 2026", price=""), CARD.replace("/inzerat/{id}/", "/jine/").format(date="1.1. 2026", price=PRICED)]
    html = "Zobrazeno 1-20 inzerátů z 7 678 <p>" + "".join(cards)
    frame = spark.createDataFrame([(1, html), (2, "nothing"), (3, None)], "page_id int, html string")
    got = pages.cards(frame, base="https://site").orderBy("card_no").collect()
    assert [(r["external_id"], r["price_minor"], r["problem"]) for r in got] == [("1", 1450000000, None), ("2", None, None), ("3", None, "unknown_price: Zítra"), ("4", 1450000000, "bad_date"), ("5", None, "no_price_div"), (None, 1450000000, "no_link")]
    r = got[0]
    assert (r["url"], r["posted_at"], r["currency"], r["address"], r["description"]) == ("https://site/inzerat/1/byt.php", dt.datetime(2026, 8, 27), "CZK", "Praha 5, 152 00", "Hezký byt & sklep")
    assert [x[0] for x in frame.orderBy("page_id").select(pages.result_count(F.col("html"))).collect()] == [7678, None, None]
    assert spark.range(1).select(pages.page_numbers(F.lit(41)), pages.page_numbers(F.lit(0))).first()[:] == ([1, 2, 3], [1])
    states = spark.createDataFrame([(0, 0, 3), (1, 0, 3), (0, 1, 3), (0, 3, 3)], "p int, f int, n int")
    assert [x[0] for x in states.select(pages.completeness(F.col("p"), F.col("f"), F.col("n"))).collect()] == ["complete", "partial", "partial", "failed"]


def test_detail(spark):
    html = ('<H1 class="nadpisdetail">Byt​ 2+kk</H1><div class="popisdetail">Úvod<br>Plocha:<br>60 m²<br>Stavba<br>cihla<br><br>2. NP<br>Ostatní:<br></div>Cena:</td><td colspan=2><br><b><span class="x"> 14 500 000 Kč'
            '</b>Jméno:</td><span class="paction">Jan &amp; syn</span>maps/place/50.08,14.42/@50.08,14.42,16z<a title="Přibližná lokalita" rel="nofollow">150 00</a>Vidělo:</td><td colspan=2><br> 42 lidí'
            + "".join(f"<img src='https://www.site.cz/img/{n}/1/2.jpg'>" for n in (1, "1t", 2, 1)))
    r, bad = pages.detail(spark.createDataFrame([(1, html), (2, "<p>")], "i int, html string")).orderBy("i").collect()
    assert (r["title"], r["price_minor"], r["currency"], r["seller_name"], r["lat"], r["zoom"], r["postcode"], r["views"], r["problem"]) == ("Byt 2+kk", 1450000000, "CZK", "Jan & syn", 50.08, 16, "150 00", 42, None)
    assert r["block"] == {"Plocha": "60 m²", "Stavba": "cihla; 2. NP"} and r["photos"] == ["https://www.site.cz/img/1/1/2.jpg", "https://www.site.cz/img/2/1/2.jpg"]
    assert bad["problem"] == "no_title" and bad["block"] == {} and bad["photos"] == []


def test_embedded_json(spark):
    cache = {"Advert:1": {"id": "1", "uri": "a-1", "price": 14500.29, "currency": "czk", "surface": 62.5, "estateType": "BYT", "gps": {"lat": 50.1, "lng": 14.4}, 'address({"locale":"CS"})': "Karlova 5", "disposition": "DISP_2_KK"},
             "Advert:2": {"id": "2", "uri": "a-2", "price": 0, "gps": {"lat": 40.0, "lng": 14.4}}, "Advert:3": {"uri": "x"}, "Other:1": {"id": "9", "uri": "z"}}
    html = f'<script x id="__NEXT_DATA__" type="j">{json.dumps({"props": {"pageProps": {"apolloCache": cache}}})}</script>'
    frame = spark.createDataFrame([(1, html), (2, html), (3, "no")], "page_id int, html string")
    rows = pages.embedded_adverts(frame, base="https://s/")
    got = {r["external_id"]: r for r in rows.where("page_id = 1").collect()}
    assert set(got) == {"1", "2"} and (got["1"]["price_minor"], got["1"]["currency"], got["1"]["area_sqm"], got["1"]["address"], got["1"]["url"]) == (1450029, "CZK", Decimal("62.50"), "Karlova 5", "https://s/a-1")
    assert got["2"]["price_minor"] is None and got["2"]["currency"] is None
    assert [(r["external_id"], r["page_id"]) for r in pages.admitted(rows).collect()] == [("1", 1)]


def test_offers(spark):
    offer = {"id": 7, "title": "t", "area": 45.5, "disposition": "2kk", "geoCoordinates": {"lat": 50.0, "lng": 14.0}, "rentalPrice": {"value": 19999.99, "currency": ""}, "absoluteUrl": "u", "offerType": "rent", "propertyType": "byt", "published": "2026-08-01T10:00:00", "street": {"title": "Lesní"}, "village": {"name": "Brno"}, "villagePart": {"title": "Brno"}, "description": "call 777 123 456", "photos": [{"path": "p1"}, {"path": "", "url": "p2"}, {}]}
    bodies = [json.dumps({"success": True, "extraData": {"total": 1}, "data": {"offers": [offer, {"id": 0}]}}), json.dumps({"success": False}), "broken"]
    got = pages.offers(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["external_id"], r["price_minor"], r["currency"], r["address"], r["description"], r["photos"], r["posted_at"]) == ("7", 1999999, "CZK", "Lesní, Brno", "call [REDACTED]", ["p1", "p2"], dt.datetime(2026, 8, 1, 10))
    held = spark.createDataFrame([('{"material": {"id": "brick"}, "lift": {"text": "Ano"}, "x": {"id": "q"}, "none": {}}',)], "p string")
    values = pages.parameters(F.col("p"), {"material": {"brick": "cihlova"}})
    assert held.select(values).first()[0] == {"material": "cihlova", "lift": "Ano", "x": "q"} and held.select(pages.yes(values["lift"])).first()[0]


def test_rates(spark, tmp_path):
    xml = tmp_path / "rates.xml"
    xml.write_text('<gesmes:Envelope xmlns:gesmes="http://g" xmlns="http://e"><gesmes:subject>x</gesmes:subject><Cube><Cube time="2026-08-03"><Cube currency="CZK" rate="24.100"/><Cube currency="JPY"/></Cube><Cube time="2026-08-02"><Cube currency="CZK" rate="24.2"/></Cube></Cube></gesmes:Envelope>')
    official = feeds.daily_rates_xml(spark, str(xml))
    assert sorted((r["quote"], r["rate"], r["rate_date"].isoformat()) for r in official.collect()) == [("CZK", Decimal("24.1000000000"), "2026-08-03"), ("CZK", Decimal("24.2000000000"), "2026-08-02")]
    body = '{"base": "EUR", "rates": {"2026-08-03": {"CZK": 99, "XXX": 1.5}, "2026-08-01": {"CZK": 24.3, "PLN": null}}}'
    mirror = feeds.daily_rates_json(spark.createDataFrame([(body,), ('{"base": "USD", "rates": {}}',)], "body string"))
    rates, skipped = feeds.merged_rates(official, mirror, spark.createDataFrame([("CZK",)], "code string"))
    assert sorted((r["rate_date"].day, float(r["rate"]), r["source"]) for r in rates.collect()) == [(1, 24.3, "mirror"), (2, 24.2, "ecb"), (3, 24.1, "ecb")]
    assert [tuple(r) for r in skipped.collect()] == [("XXX", 1)]


def test_zone_features(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    f = lambda code, level, parent, kind="Polygon", c=square, name="n": {"type": "Feature", "properties": {"external_code": code, "name": name, "level": level, "parent_code": parent}, "geometry": {"type": kind, "coordinates": c}}
    path = tmp_path / "z.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [f("r", "region", None), f("m", "municipality", "r", "MultiPolygon", [square]), f("z", "zone", "r"), f("x", "planet", None), f("d", "zone", "m"), f("d", "zone", "m"), f("p", "zone", "m", "Point", [0, 0]), f("n", "zone", "m", name=" ")]}))
    zones, errors = feeds.zone_features(spark, str(path), "cz", "src")
    assert {r["external_code"]: len(r["rings"][0]) for r in zones.collect()} == {"r": 5, "m": 5, "z": 5}
    assert sorted((r["external_code"], r["error"]) for r in errors.collect()) == [("d", "duplicate_code"), ("d", "duplicate_code"), ("n", "no_name"), ("p", "no_polygon"), ("x", "bad_level")]
    linked = {r["external_code"]: (r["parent_id"], r["parent_problem"]) for r in feeds.linked_by_code(zones.withColumn("id", F.ascii("external_code"))).collect()}
    assert linked == {"r": (None, None), "m": (ord("r"), None), "z": (None, "unresolved")}


def test_quotations(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("codzona;tipo;contratto;prezzo_min;prezzo_max;periodo\nz1;A;vendita;1450;1600;2025/1\nm1;A;affitto;8.50;9.20;2025-H2\nz1;S;vendita;;1200;2025s1\n")
    zones = spark.createDataFrame([(1, "IT", "z1"), (2, "IT", "m1")], "id long, country string, external_code string")
    good, errors = feeds.quotations(feeds.read_quotations(spark, str(path)), zones, "IT")
    assert sorted((r["zone_id"], r["deal_type"], r["price_min_minor"] or 0, r["price_max_minor"], r["period_start"].isoformat()) for r in good.collect()) == [(1, "sale", 0, 120000, "2025-01-01"), (1, "sale", 145000, 160000, "2025-01-01"), (2, "rent", 850, 920, "2025-07-01")]
    assert errors.count() == 0
    bad = spark.createDataFrame([("", "A", "vendita", "1", "2", "2025/1"), ("q", "A", "vendita", "1", "2", "2025/1"), ("z1", "", "vendita", "1", "2", "2025/1"), ("z1", "A", "x", "1", "2", "2025/1"), ("z1", "A", "vendita", "1.234", "2", "2025/1"), ("z1", "A", "vendita", "3", "2", "2025/1"), ("z1", "A", "vendita", "1", "2", "2025/3"), ("z1", "A", "vendita", "1", "-2", "2025/1")], ", ".join(f"{c} string" for c in feeds.QUOTATION_COLUMNS))
    assert sorted(r["error"] for r in feeds.quotations(bad, zones, "IT")[1].collect()) == sorted(["no_zone", "unknown_zone", "no_type", "bad_deal", "bad_price_min", "max_below_min", "bad_period", "bad_price_max"])
    with pytest.raises(ValueError):
        feeds.quotations(bad.drop("tipo"), zones, "IT")


def test_crawl_rules(spark):
    files = spark.createDataFrame([("a.cz", "User-agent: *\nDisallow: /search\nDisallow: /*q=\nAllow: /search/ok$ # note\n\nUser-agent: Bot\nUser-agent: Other\nDisallow:\n"), ("b.cz", "User-agent: *\nDisallow: /")], "host string, text string")
    rules = feeds.crawl_rules(files)
    links = ["https://a.cz/x", "https://a.cz/search?z", "https://a.cz/search/ok", "https://a.cz/search/ok/x", "https://a.cz/y?q=1", "https://b.cz", "https://c.cz/"]
    frame = spark.createDataFrame([(u,) for u in links], "url string")
    ok = lambda agent: {r["url"]: r["allowed"] for r in feeds.crawl_allowed(frame, rules, agent).collect()}
    assert [ok("mine/1.0")[u] for u in links] == [True, False, True, False, False, False, True]
    assert [ok("MyBot/2")[u] for u in links] == [True] * 5 + [False, True]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        tables.append(rows, str(tmp_path / "log"), ["v"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    for name in ("2026-01", "2026-03", "2026-02"):
        (tmp_path / "art" / name).mkdir(parents=True)
        (tmp_path / "art" / name / "x.json").write_text(name)
    newest = tables.newest_folder(spark, str(tmp_path / "art")).collect()
    assert [bytes(r["content"]).decode() for r in newest] == ["2026-03"]
    tables.register("cards", pages.cards)
    assert tables.connector("cards") is pages.cards
    with pytest.raises(ValueError):
        tables.register("cards", pages.cards)
    with pytest.raises(ValueError):
        tables.connector("unknown")


def test_paged_source(spark, tmp_path):
    """A folder of pages read in ranges, as a batch and as a stream that goes on where it stopped; what fails makes a run partial or failed."""
    paged.register(spark)
    folder = tmp_path / "pages"
    folder.mkdir()
    write = lambda n, cards: (folder / f"{n:05d}.html").write_text("inzerátů z 7" + "".join(CARD.format(id=i, date="27.8. 2026", price=PRICED) for i in cards))
    for n in (1, 2, 3, 5):
        write(n, [10 * n, 10 * n + 1])
    (folder / "notes.txt").write_text("x")
    load = lambda **options: spark.read.format("listing_pages").options(path=str(folder), **options).load()
    whole = load(pagesPerPartition="2")
    assert whole.rdd.getNumPartitions() == 3 and sorted((r["page"], r["problem"]) for r in whole.collect()) == [(1, None), (2, None), (3, None), (4, "network"), (5, None)]
    listings, report = paged.scan(whole, base="https://s")
    assert {r["external_id"] for r in listings.collect()} == {"10", "11", "20", "21", "30", "31", "50", "51"}
    assert report.first().asDict() == {"completeness": "partial", "pages": 5, "failed_pages": 1, "bad_cards": 0, "issues": {"network": 1}}
    assert paged.scan(load(pages="3"))[1].first().asDict() == {"completeness": "complete", "pages": 3, "failed_pages": 0, "bad_cards": 0, "issues": {}}
    (folder / "00004.html").write_bytes(b"\xff\xfe")
    (folder / "00006.html").write_text('<div class="g-recaptcha"></div>')
    write(7, [])
    (folder / "00007.html").write_text(CARD.replace("/inzerat/{id}/", "/jine/").format(date="1.1. 2026", price=PRICED))
    assert paged.scan(load())[1].first().asDict() == {"completeness": "partial", "pages": 7, "failed_pages": 2, "bad_cards": 1, "issues": {"captcha": 1, "layout_change": 2}}
    gone = spark.read.format("listing_pages").options(path=str(tmp_path / "none"), pages="2").load()
    assert paged.scan(gone)[1].first()["completeness"] == "failed"
    with pytest.raises(Exception, match="pagesPerPartition"):
        load(pagesPerPartition="0").collect()

    stream = spark.readStream.format("listing_pages").option("path", str(folder)).option("pagesPerPartition", "3").load()
    batches = []
    for n in (7, 9):
        for k in range(8, n + 1):
            write(k, [10 * k])
        q = stream.writeStream.foreachBatch(lambda df, _: batches.append(sorted(r["page"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert [p for b in batches for p in b] == list(range(1, 10)) and batches[-1] == [8, 9]
