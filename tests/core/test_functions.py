"""Scalar functions against tables of expected values."""

import datetime as dt
import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hearthline.functions import areas, attributes, classes, geo, language, money, scheduling, student, text, urls
from hearthline.session import shared_folder


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_money(spark):
    good = {"1234.56": 123456, "1234,56": 123456, "1 234.56": 123456, "0.05": 5, ".56": 56, "5.": 500, "-12.3": -1230, "0": 0, "1.234,50": None, "1 000": 100000}
    got = column(spark, list(good), money.parse_money)
    assert [g["minor"] for g in got] == list(good.values())
    bad = column(spark, ["", "1.234", "abc", "99999999999999999", None, "-"], money.parse_money)
    assert [g["error"] for g in bad] == ["empty", "too_precise", "malformed", "too_large", "empty", "malformed"] and all(g["minor"] is None for g in bad)
    assert column(spark, [123456, -5, 0, 7], money.format_minor, "long") == ["1234.56", "-0.05", "0.00", "0.07"]
    assert column(spark, [1234], lambda c: money.format_minor(c, 0), "long") == ["1234"]


def test_rates(spark):
    rate = F.lit("24.1").cast("decimal(20,10)")
    assert column(spark, [100, 310, 20747, -100], lambda c: money.apply_rate(c, rate), "long") == [2410, 7471, 500003, -2410]
    assert column(spark, [1000, 1], lambda c: money.apply_rate(c, rate, inverse=True), "long") == [41, 0]
    assert column(spark, [1, -1, 3], lambda c: money.apply_rate(c, F.lit("0.5").cast("decimal(20,10)")), "long") == [1, -1, 2]
    assert column(spark, [100], lambda c: money.apply_rate(c, rate, 2, 0), "long") == [24]
    assert column(spark, [1000], lambda c: money.convert(c, F.lit("EUR"), "EUR", rate, rate), "long") == [1000]


def test_text(spark):
    assert column(spark, ["Karlova ul. 5, Praha", "Nám. 1"], text.address_key) == ["karlovaul5praha", "nm1"]
    pairs = spark.createDataFrame([("", ""), ("a", ""), ("kitten", "sitting"), ("abcdefghij", "abcdefghix")], "a string, b string")
    assert [round(r[0], 4) for r in pairs.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, round(1 - 3 / 7, 4), 0.9]
    assert column(spark, ["  A\t B\n", "ŘEKA"], text.normalised) == ["a b", "řeka"]
    hit = lambda p: lambda c: text.phrase_hit(c, F.lit(p))
    assert column(spark, ["12kk", "2kk", "a 2kk,", "č2kk"], hit("2kk")) == [False, True, True, False]
    assert column(spark, ["bezva", "je bez", "b.z"], hit("bez")) == [False, True, False] and column(spark, ["x"], hit("")) == [False]
    assert column(spark, ["82,01", "1.234", "1.234,56", "1.5", "1 110", "x", "", "1,2,3"], text.czech_number) == [82.01, 1234.0, 1234.56, 1.5, 1110.0, None, None, None]
    assert column(spark, ["a<br>b &amp; <b>c</b>&nbsp;d  e "], text.html_text) == ["a\nb & c d e"]
    assert column(spark, ["Žluťoučký Kůň"], text.without_accents) == ["Zlutoucky Kun"]


def test_redact(spark):
    raw = ["mail a.b@c.cz end", "+420 777 123 456", "call 777 123 456 now", "tel: 608111222", "price 6 500 000", "code 1777 123 4567"]
    r = text.REDACTED
    assert column(spark, raw, text.redact) == [f"mail {r} end", r, f"call {r} now", r, "price 6 500 000", "code 1777 123 4567"]
    odd = ["tel: 777\t123\t456", "tel.\n777123456", "+420\n777-123 456", "+420777123456789", "Telefon...608111222x", "phone 6081112223", "hotel:608111222", "+608111222", "a777 123 456", "777 123 456a", "777  123 456", "777 123 456 777 123 456", "1 777 123 456 2", "577 123 456",
           "x@y.cz.", "@y.cz", "a@b", "a@b.c1", "a..b+%_-@x-y.co.uk, b@c.com@d.cz", "a@.cz", "ž@y.cz", "a@b.c.d", "", "777 123 45", "tel 5 608111222", "+421 777 123 456"]
    assert column(spark, odd, text.redact) == [f"tel: {r}", r, r, f"{r}789", f"{r}x", f"{r}3", f"ho{r}", "+608111222", "a777 123 456", "777 123 456a", "777  123 456", f"{r} {r}", f"1 {r} 2", "577 123 456",
                                              f"{r}.", "@y.cz", "a@b", "a@b.c1", f"{r}, {r}@d.cz", "a@.cz", "ž@y.cz", "a@b.c.d", "", "777 123 45", "tel 5 608111222", f"+421 {r}"]
    body = ['{"title": "flat", "seller": {"email": "x@y.cz"}, "list": [{"Phone": "1"}], "n": 3}', "[1, 2]", "no json", '{"bad', None]
    assert column(spark, body, text.redact_json) == ['{"title": "flat", "seller": "[REDACTED]", "list": [{"Phone": "[REDACTED]"}], "n": 3}', "[1, 2]", "no json", '{"bad', None]


def test_page_classes(spark):
    rows = spark.createDataFrame([(200, None, None, '<div class="g-recaptcha">'), (200, None, None, 'hcaptcha prodej 65 m²'), (403, "DDoS-Guard", None, "x"), (200, None, "challenge", "x"), (200, None, None, 'login <input type="password">'), (200, None, None, "cookiebot"), (403, None, None, "Access Denied"), (200, None, None, "ok")], "s int, srv string, mit string, b string")
    assert [r[0] for r in rows.select(text.protection(F.col("s"), F.col("srv"), F.col("mit"), F.col("b"))).collect()] == ["captcha", None, "challenge", "challenge", "login", "challenge", "challenge", None]
    people = spark.createDataFrame([("Realitní kancelář X", ""), ("Petr", "REALITNÍ kanceláře NEVOLAT!"), ("Stavební společnost Y a.s.", ""), ("Společnost Z a.s.", ""), ("Jan", "hezký byt"), (None, None)], "n string, d string")
    kind = text.seller_type(F.col("n"), F.col("d"))
    assert [tuple(r) for r in people.select(kind, text.seller_confidence(kind)).collect()] == [("agency", 0.85), ("private", 0.9), ("developer", 0.85), ("agency", 0.85), (None, None), (None, None)]
    mined = spark.createDataFrame([("a", "a b", "a b c"), ("a1", "a1", "a1"), ("xx", "yy", "yy"), ("yy", "yy", "zz"), ("Byt", "byt s", "velký BYT  s")], "p string, q string, t string")
    assert [r[0] for r in mined.select(text.mine_guard(F.col("p"), F.col("q"), F.col("t"))).collect()] == ["too_short", "has_digit", "not_in_quote", "not_in_text", None]


def test_language(spark):
    samples = {"Prodáme světlý byt s velkou kuchyní, nová podlaha, klidná ulice, blízko lesů a metra.": "cs", "Vendiamo un appartamento con riscaldamento nuovo e posizione tranquilla vicino agli uffici.": "it",
               "Wij verkopen een woonhuis met ruime keuken, rustig gelegen bij het station, geen tuin.": "nl", "The house is for sale and the kitchen is looking out to the garden.": "en", "Продаётся светлая квартира рядом с парком": "ru"}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*samples, "Byt na prodej", "", "123 456", None])], "i int, v string")
    got = language.detect(rows, "v").orderBy("i").collect()
    assert [g["detected"] for g in got] == [*samples.values(), None, None, None, None]
    assert all(g["detected_confidence"] >= 0.35 for g in got[:5]) and [g["detected_confidence"] for g in got[5:]] == [0, 0, 0, 0]
    assert column(spark, ["ru", "cs", None], language.targets) == [["en"], ["ru", "en"], ["ru", "en"]]


AREAS = [
    ("jednotka o celkové rozloze 109 m² (z toho 9 m² tvoří sklep)", 109, 109), ("s celkovou plochu 35 m² a užitnou plochu 32 m²", 35, 35), ("celková plocha 63 m², z toho užitná 32 m²", 63, 63), ("byt, užitná plocha 45 m²", 45, None), ("z toho užitná 32 m²", 32, None),
    ("hezký 3+kk byt, 68 m²", 68, None), ("byt 65 m², sklep 9 m²", 65, None), ("sklep 9 m²", None, None), ("pozemek 1500 m², byt 65 m²", 65, None), ("z čehož 9 m² tvoří sklep, byt 65 m²", 65, None), ("5,5 m2 sklep, celková plocha 63 m²", 63, 63),
    ("celkové ploše včetně balkónu 45,9 m²", 45.9, 45.9), ("45,9 m² včetně balkonu", 45.9, None), ("dům 65 m² balkón 12 m²", 65, None), ("9 m² tvoří sklep 5 m²", None, None), ("sklep 3 m². Byt 65 m²", 65, None), ("velký byt 5+1 110 m²", 110, None), ("byt 1+1 40 m² + garáž", 40, None),
    ("rodinný dům 1 110 m²", 1110, None), ("byt 70 m² s terasou", 70, None), ("celková plocha vč. balkonu 45,9 m²", 45.9, 45.9), ("o celkové výměře 82,01 m²", 82.01, 82.01), ("celková plocha 63 m² + 5,5 m2 sklep", 63, 63), ("", None, None), ("byt 3 m²", None, None),
]


def test_areas(spark):
    for said, area, total in AREAS:
        assert (areas.choose(areas.areas(said)), areas.choose(areas.areas(said), True)) == (area, total), said
    rows = spark.createDataFrame([(s,) for s, _, _ in AREAS] + [(None,)], "v string")
    assert [r[0] for r in rows.select(areas.area_of(F.col("v"))).collect()] == [a for _, a, _ in AREAS] + [None]


def test_attributes(spark):
    listing = attributes.Listing(F.col("t"), F.col("d"), F.col("b"))
    derived = attributes.derive(listing)
    d = "Byt v cihlovém domě, ve 4. patře domu s 8 podlažími, bez výtahu, osobním vlastnictvím, velmi dobrý stav. Poplatky 2000-3000 Kč/měsíc. Postaven v roce 1998. Energetická třída C. Pozemek o ploše 5 ar. Novostavba."
    rows = spark.createDataFrame([("Byt 2+kk 54 m²", d, {"Plocha": "celková plocha 60 m²", "Vlastnictví": "Družstevní", "Energetická náročnost": "Úsporná"}), ("Dům", "původně 3+1, nyní 4+1, dvoupodlažní, v přízemí", {}), (None, None, {})], "t string, d string, b map<string,string>")
    first, second, third = rows.select(*[c.alias(n) for n, c in derived.items()]).collect()
    value = lambda row: {n: row[n]["value"] if row[n] else None for n in derived}
    assert value(first) == {"area": "60.0", "total_area": "60.0", "rooms": "2", "floor": "4", "floors": "8", "material": "cihlova", "energy": "usporne", "ownership": "druzstevni", "condition": "very_good", "elevator": "false", "new_build": "true", "year_built": "1998", "monthly": "2000.0", "plot_area": "500.0"}
    assert (first["area"]["method"], first["area"]["confidence"], first["rooms"]["confidence"], first["floor"]["confidence"]) == ("source_field", 1.0, 0.9, 0.8)
    assert {k: v for k, v in value(second).items() if v} == {"rooms": "4", "floor": "1", "floors": "2"}
    assert not any(value(third).values())
    words = spark.createDataFrame([("cihlopanelový dům", "ve druhém podlaží", "OV"), ("panelák", "2. NP", "osobní výtah")], "a string, b string, c string")
    got = words.select(attributes._ladder(F.col("a"), attributes.MATERIALS), attributes.floor(F.col("b")), attributes.ownership(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("cihlopanelova", 2, "osobni"), ("panelova", 2, None)]


def test_streets(spark):
    cases = [("byt v ulici Lesní, u parku", "Brno", "Lesní"), ("na ulici Vysoká 2 v Brně", "Brno", "Vysoká 2"), ("na ul. Na Vršku 1643/5, Ostrava", "Ostrava", "Na Vršku 1643/5"), ("Prodej 2+kk, Polní 2842/1, Plzeň", "Plzeň", "Polní 2842/1"), ("byt 1+kk 45 m²", "Praha", None),
             ("v ulici Praha 5 byt", "Praha 5", None), ("ulice Pod kopcem", "Zlín", None), ("", "Brno", None)]
    rows = spark.createDataFrame([(t, c) for t, c, _ in cases], "t string, c string")
    assert [r[0] for r in rows.select(attributes.street(F.col("t"), F.col("c"))).collect()] == [w for _, _, w in cases]
    assert [tuple(r) for r in column(spark, ["Praha 5, 150 00", "Frýdek - Místek, 73801", "150 00", "Zlín"], attributes.city_postcode)] == [("Praha 5", "150 00"), ("Frýdek - Místek", "738 01"), (None, "150 00"), ("Zlín", None)]


def test_geo(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    shape = spark.createDataFrame([([[{"x": x, "y": y} for x, y in r] for r in (ring, hole)],)], "rings array<array<struct<x:double,y:double>>>")
    inside = lambda x, y: geo.in_polygon(F.lit(x), F.lit(y), F.col("rings"))
    row = shape.select(inside(0.5, 0.5).alias("a"), inside(1.5, 1.5).alias("b"), inside(5.0, 1.0).alias("c"), inside(3.0, 2.9).alias("d"), geo.polygon_area(F.col("rings")).alias("area"), geo.inner_point(F.col("rings")).alias("p"), geo.bounds(F.col("rings")).alias("box"), geo.geojson(F.col("rings")).alias("json"), F.size(geo.cells_of(geo.bounds(F.col("rings")), 1.0)).alias("n")).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["area"]) == (True, False, False, True, 11.0)
    assert tuple(row["box"]) == (0.0, 0.0, 4.0, 3.0) and row["n"] == 20 and row["json"].startswith('{"type":"Polygon","coordinates":[[[0.0,0.0],')
    assert 2 < row["p"]["x"] < 4 and row["p"]["y"] == 1.5
    line = spark.createDataFrame([([{"x": float(i), "y": 0.001 * (i % 2)} for i in range(9)] + [{"x": 8.0, "y": 5.0}],)], "r array<struct<x:double,y:double>>")
    assert [(p["x"], p["y"]) for p in line.select(geo.simplified(F.col("r"), 0.01)).first()[0]] == [(0.0, 0.0), (8.0, 0.0), (8.0, 5.0)]
    assert column(spark, ["zone", "street", None, "x"], geo.level_rank) == [0, 3, -1, -1]
    assert column(spark, [17, 16, 14, 1, 0, None], geo.zoom_level, "int") == ["street", "street", "municipality", "postcode", None, None]
    assert math.isclose(spark.range(1).select(geo.haversine_km(F.lit(50.0), F.lit(14.0), F.lit(50.0), F.lit(15.0))).first()[0], 71.47, abs_tol=0.01)
    assert geo.parse_box("1,2,3,4") == (1, 2, 3, 4) and geo.check_zoom(14, (0, 0, 1, 1)) == 14
    for bad in ("1,2,3", "a,2,3,4", "3,2,1,4", "0,0,0,99"):
        with pytest.raises(ValueError):
            geo.parse_box(bad)
    for zoom, box in ((23, None), (5, (-100, -50, 100, 50))):
        with pytest.raises(ValueError):
            geo.check_zoom(zoom, box)


def test_resolve_position(spark):
    rows = [  # lat, lng, level, zoom, glat, glng, gtype, place, street -> source, level
        (50.0, 14.0, None, 16, 50.1, 14.1, "house", True, True, "source", "street"), (50.0, 14.0, None, 13, 50.01, 14.01, "house", True, True, "geocoder", "building"), (50.0, 14.0, None, 13, 50.01, 14.01, "house", True, False, "source", "municipality"),
        (50.0, 14.0, None, 13, 52.0, 14.0, "house", True, True, "source", "municipality"), (50.0, 14.0, None, 13, 50.01, 14.0, "city", True, True, "source", "municipality"), (None, None, None, None, 50.0, 14.0, "city", True, False, "geocoder", "municipality"), (None, None, None, None, None, None, None, True, True, None, None)]
    frame = spark.createDataFrame([r[:9] for r in rows], "a double, b double, l string, z int, c double, d double, t string, p boolean, s boolean")
    got = frame.select(geo.resolve_position(*[F.col(c) for c in "ablzcdtps"]).alias("r")).select("r.*").collect()
    assert [(r["source"], r["level"]) for r in got] == [r[9:] for r in rows]


def test_urls(spark):
    assert column(spark, ["https://WWW.A.cz:80/x", "//b.cz/", "nothing", "http://u@c.cz?q"], urls.host) == ["www.a.cz", "b.cz", None, "c.cz"]
    assert column(spark, [" https://www.Site.cz/path ", "site.cz:8080"], urls.domain) == ["site.cz", "site.cz"]
    assert column(spark, ["/a/b.PNG?x=1", "/a/b.html", "/a.js#z"], urls.is_asset) == [True, False, True]
    assert column(spark, ['<a class="x" href="/1">a</a><A HREF="/2">'], urls.hrefs) == [["/1", "/2"]]
    assert column(spark, ['<a rel="next" href="/p2">'], urls.next_page) == ["/p2"]
    pairs = spark.createDataFrame([("http://a.cz/x/y", "../z"), ("http://a.cz", "//b.cz/q"), (None, "x")], "b string, l string")
    assert [r[0] for r in pairs.select(urls.resolved(F.col("b"), F.col("l"))).collect()] == ["http://a.cz/z", "http://b.cz/q", None]
    live, section = '<H1 class="nadpisdetail">x', '<title>Byty - inzerce</title>'
    rows = [(404, None, None, ""), (301, None, "https://a.cz/inzeraty/byt/", ""), (301, None, "https://a.cz/inzerat/2/x", ""), (301, None, "https://b.cz/", ""), (200, "https://a.cz/inzerat/1/new", None, live), (200, "https://a.cz/inzerat/2/x", None, live), (200, "https://a.cz/inzerat/1/old", None, section), (200, "https://a.cz/inzerat/1/old", None, "?"), (503, None, None, "")]
    frame = spark.createDataFrame([(s, "https://a.cz/inzerat/1/old", r, loc, b) for s, r, loc, b in rows], "s int, a string, r string, l string, b string")
    got = [r[0] for r in frame.select(urls.url_verdict(F.col("s"), F.col("a"), F.col("r"), F.col("l"), F.col("b"))).collect()]
    assert got == ["unknown", "unknown", None, None, "alive", "relisted", "unknown", None, None]


def test_scheduling(spark):
    assert column(spark, [1, 2, 7, 8, 50, 0], lambda c: scheduling.backoff_minutes(c) / 60, "int") == [1, 2, 64, 72, 72, 1]
    caps = spark.createDataFrame([(4, 1.0), (4, 0.5), (4, 0.25), (4, 0.1), (3, 0.5), (3, 0.33)], "n int, f double")
    assert [r[0] for r in caps.select(scheduling.effective_cap(F.col("n"), F.col("f"))).collect()] == [4, 2, 1, 0, 1, 0]
    weigh = spark.createDataFrame([(2.0, 2.0, False), (2 / 3, 2.0, False), (0.0, 2.0, False), (0.0, 0.0, False), (1.0, 2.0, True)], "a double, m double, w boolean")
    assert [round(r[0], 6) for r in weigh.select(scheduling.window_weight(F.col("a"), F.col("m"), F.col("w"))).collect()] == [1.0, 0.4, 0.1, 0.1, 1.0]
    assert scheduling.parse_spec("5, 1-3,2", 0, 6) == [1, 2, 3, 5]
    for bad in ("", "7", "3-1", "x", "1-9"):
        with pytest.raises(ValueError):
            scheduling.parse_spec(bad, 0, 6)
    at = spark.createDataFrame([(dt.datetime(2026, 8, 2, 23, 30),)], "t timestamp")
    assert tuple(at.select(*scheduling.local_slot(F.col("t"), "Europe/Prague")).first()) == (1, 1) and at.select(scheduling.slot_key(*scheduling.local_slot(F.col("t")))).first()[0] == "0-23"
    guard = spark.createDataFrame([(0, 0), (0, 5), (2, 10), (3, 10)], "d int, v int")
    assert [r[0] for r in guard.select(scheduling.delist_guard(F.col("d"), F.col("v"), 30.0, 6)).collect()] == [False, False, False, True]
    controls = spark.createDataFrame([(0, 0), (4, 2), (5, 2)], "n int, a int")
    assert [r[0] for r in controls.select(scheduling.controls_verdict(F.col("n"), F.col("a"))).collect()] == ["unverifiable", "healthy", "broken"]


def test_classes(spark):
    assert column(spark, [-0.15, -0.1, -0.05, 0.05, 0.1, 0.15, None], classes.deviation_class, "double") == ["far_below", "below", "near", "near", "above", "far_above", "none"]
    rows = spark.createDataFrame([("true", "bool"), ("x", "bool"), ("B", "enum"), ("z", "enum"), ("3", "int"), ("3.5", "int"), ("99", "int"), ("1e1", "float"), (None, "int")], "v string, t string")
    got = [r[0] for r in rows.select(classes.valid_value(F.col("v"), F.col("t"), F.array(F.lit("a"), F.lit("b")), F.lit(1.0), F.lit(50.0))).collect()]
    assert got == [None, "not_bool", None, "not_allowed", None, "not_int", "out_of_range", None, "missing"]


def test_student():
    for freedom, want in ((1, 12.706205), (2, 4.302653), (5, 2.570582), (17, 2.109816), (30, 2.042272), (100, 1.983972), (1000, 1.962345)):
        assert student.t_quantile(0.975, freedom) == pytest.approx(want, abs=1e-5)
    assert student.t_cdf(0, 17) == pytest.approx(0.5) and student.t_cdf(1.3, 9) + student.t_cdf(-1.3, 9) == pytest.approx(1)
    assert student.t_quantile(0.1, 7) == -student.t_quantile(0.9, 7)


def test_shared_folder_on_a_cluster():
    """Without spark.checkpoint.dir only a local session gets a folder of its own."""
    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: unset)))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(cluster)
    assert shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y"))) == "hdfs://x/y"
