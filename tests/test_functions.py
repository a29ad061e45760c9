"""Column functions, file sources and layers on literals and small tables."""

import random
from decimal import Decimal
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from linkwright.functions import identifiers, money, offers, text
from linkwright.operators import matching, pages, similarity
from linkwright.operators.offers import feed_matches
from linkwright.plans import cascade
from linkwright.sources import files, providers

ODD = "à partir de 30€ livraison gratuite"


def value(spark, f, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


@pytest.mark.parametrize(("f", "given", "want"), [
    (identifiers.ean, "036000291452", "0036000291452"), (identifiers.gtin, "036000291452", "036000291452"), (identifiers.ean, "4006381333932", None), (identifiers.ean, "400-6381333931", "4006381333931"), (identifiers.ean, "", None),
    (identifiers.barcode, "8,02586E+12", None), (identifiers.sku, " ab c-1 ", "ABC-1"), (text.title, "Café  w/ 2 pcs & Ünits!", "cafe with 2 pieces and units"), (text.brand, " Hewlett-Packard ", "hp"), (text.brand, " ", None), (text.brand_in_title, "New SONY Camera", "sony"),
    (lambda c: text.title(c, beyond_latin=True), "Ḝ ﬁn  Ώx", "e fin x"), (text.title, "", ""), (text.title, None, None), (offers.market_of_code, " uk ", "UK"), (offers.market_of_code, "xx", None), (offers.market_of_url, "a.com", None),
    (money.loose_price, "1.299,00", Decimal("1299.0000")), (money.loose_price, "1,299.50", Decimal("1299.5000")), (money.loose_price, "1.299", Decimal("1299.0000")), (money.loose_price, "12,5", Decimal("12.5000")), (money.loose_price, "abc", None),
    (offers.availability, "Non disponibile", "OUT_OF_STOCK"), (offers.availability, "https://schema.org/PreOrder", "PREORDER"), (offers.availability, "1", "IN_STOCK"), (offers.availability, None, "UNKNOWN"), (offers.stock_in_text, "solo 3 pezzi disponibili", 3), (offers.stock_in_text, "disponibili in 2 giorni", None),
    (offers.domain, "HTTPS://WWW.Shop.it:80/x", "shop.it:80"), (offers.domain, "shop.it/x", ""), (offers.market_of_url, "shop.co.uk/x", "UK"), (offers.market_of_url, "https://a.de", "DE"), (offers.url, "https://WWW.Shop.it/p/123/?utm_source=g&ref=abc&color=blue#frag", "https://shop.it/p/123?color=blue"),
])
def test_value(spark, f, given, want):
    assert value(spark, f, given) == want


def test_money(spark):
    rates = {"IT": ("1.299,90", "1299.9000"), "UK": ("1,299.90", "1299.9000")}
    assert all(value(spark, money.price, raw, market) == Decimal(want) for market, (raw, want) in rates.items())
    row = spark.sql("select cast(211.75 as decimal(18,4)) a, cast(239 as decimal(18,4)) b, cast(0.22 as decimal(5,4)) r")
    got = row.select(money.split_vat(F.col("a"), F.lit(True), F.col("r")).alias("x"), money.split_vat(F.col("b"), F.lit(False), F.col("r")).alias("y")).first()
    assert [float(v) for v in got.x] == [173.57, 38.18, 211.75] and [float(v) for v in got.y] == [239.0, 52.58, 291.58]
    ship = lambda t: value(spark, lambda c: money.shipping_in_text(c, F.lit("IT")), t)
    assert (ship("Spedizione gratuita"), ship("Spedizione gratuita sopra 99€"), ship("Consegna: 4,99€"), ship("€239"), ship(ODD)) == (0, None, Decimal("4.9900"), None, None)


def test_indel_ratio():
    def lcs(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    pairs = [("SAM-GAL-S21", "SAMGALS21"), ("", "A"), ("ABAB", "BABA"), ("XYZ", "XYZ"), ("A", ""), ("", ""), ("AB" * 32, "BA" * 40), ("é日B", "日é"), ("A" * 64, "A" * 70)]
    r = random.Random(2)
    pairs += [tuple("".join(r.choice("AB") for _ in range(r.randint(0, 64))) for _ in "xy") for _ in range(50)]
    assert all(similarity.common_subsequence(a, b) == lcs(a, b) for a, b in pairs)
    assert similarity.common_subsequences(*map(list, zip(*pairs, strict=True))).tolist() == [lcs(a, b) for a, b in pairs]


def test_files_to_landscape(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿SKU,EAN,Marca,Title,Country,price,colour\nAB-123,4006381333931,Hewlett-Packard,Stapler red,IT,\"110,00\",red\nZZ-9,\"8,02586E+12\",Sony,Camera x100,IT,,\n", encoding="utf-8")
    (tmp_path / "o.csv").write_text("product_id;name;brand;ean;sku;price;shipping;url\nA;Stapler;HP;4006381333931;;100,00;0;https://a.it/1\nB;Stapler red;HP;;AB123;\"1.090,00\";5;https://b.it/2\nC;Camera x100;Sony;;;300,00;;https://c.it/3\nD;Other thing;Zed;4006381333931;;80,00;;\n", encoding="utf-8")
    raw_c, raw_o = files.read_csv(spark, str(tmp_path / "c.csv")), files.read_csv(spark, str(tmp_path / "o.csv"))
    assert files.detect_market(raw_c, raw_o) == "IT"
    catalog, found = files.catalog(raw_c), files.offers(raw_o)
    rows = {r.sku: r for r in catalog.collect()}
    assert rows["AB-123"].attributes == {"colour": "red"} and rows["AB-123"].price == 110 and rows["ZZ-9"].ean is None
    linked = cascade.link(catalog, found, 0.60)
    by_id = {(r.product, r.source_id): (r.match_method, r.confidence) for r in linked.accepted.join(catalog.select(F.col("row_idx").alias("catalog_idx"), F.col("sku").alias("product")), "catalog_idx").collect()}
    assert by_id[("AB-123", "A")] == ("EXACT_EAN", 0.95) and by_id[("AB-123", "D")] == ("EXACT_EAN", 0.70)
    assert by_id[("AB-123", "B")] == ("SKU_BRAND", 0.9091) and by_id[("ZZ-9", "C")][0] == "SEMANTIC"
    with pytest.raises(files.InputError):
        files.catalog(spark.createDataFrame([("", "x", "y", 0)], "sku string, title string, brand string, row_idx long"))


def test_providers(spark):
    one = lambda body: spark.createDataFrame([(1, body), (2, "{bad")], "catalog_idx long, body string")
    web = providers.searxng(one('{"results":[{"title":"a","url":"u","content":"solo 12,50 €"},{"title":"b"},{"title":"a2","url":"u"}]}')).collect()
    assert [(r.title, r.price) for r in web] == [("a", Decimal("12.5000"))]
    nested = providers.dataforseo(one('{"status_code":20000,"tasks":[{"result":[{"items":[{"title":"t","url":"u","price":{"current":9.5,"currency":"EUR"}},{"title":"t","url":"v"}]}]}]}')).collect()
    assert [(r.url, r.price, r.currency) for r in nested] == [("u", Decimal("9.5000"), "EUR")]
    assert providers.keepa(one('{"products":[{"asin":"B1","title":"t","stats":{"current":[1999]}},{"asin":"B2","title":"t","stats":{"current":[-1]}}]}')).first().price == Decimal("19.9900")


PRODUCTS = [(1, "ABC-77", "Sony", "Camera Red", "4006381333931", None), (2, None, "Dell", "Laptop", None, None), (3, "z", "Zed", "Lens", None, "00012345600012"), (4, "q7", "Bosch", "Drill 18V  Set", "036000291452", None), (5, " ", None, "ears", None, None), (6, "X1Y", "ab", "c", "bad", "bad")]
ITEMS = [
    (1, "x", "4006381333931"), (2, "the abc-77z", None), (3, "red sony camera bag", None), (4, "red camera", None), (5, "dell laptops 15", None), (6, "Zebra", None), (7, "boschdrills 18v presets", None), (8, "nq7", ""), (9, None, "0036000291452"), (10, "", None),
    (11, "cab", None), (12, "headphones for years", "00012345600012"), (13, "RED SONY CAMERA BAG", None), (13, "RED SONY CAMERA BAG", None),
]


def in_feed(product, item):
    """The rule for one pair, in plain Python."""

    def code(*values):
        for v in values:
            d = "".join(c for c in v or "" if c.isdigit())
            for f in (d.zfill(13) if len(d) == 12 else d, d):
                if len(f) in (8, 12, 13, 14) and sum((3 if i % 2 else 1) * int(c) for i, c in enumerate(reversed(f))) % 10 == 0:
                    return f

    _, sku, brand, title, ean, gtin = product
    _, text, other = item
    mine, text = code(ean, gtin), (text or "").lower()
    tokens = " ".join(filter(None, (brand, title))).lower().split()
    return bool(mine and mine == code(other) or (sku or "").strip().lower() and sku.strip().lower() in text or text and tokens and all(t in text for t in tokens))


def test_feed_matches(spark):
    catalog = spark.createDataFrame(PRODUCTS, "row_idx long, sku string, brand string, title string, ean string, gtin string")
    feed = spark.createDataFrame(ITEMS, "item_idx long, title string, ean string")
    got = [tuple(r) for r in feed_matches(catalog, feed).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p[0], i[0]) for p in PRODUCTS for i in ITEMS if in_feed(p, i)}
    assert {(3, 6), (4, 7), (4, 9), (5, 12), (1, 13)} <= set(got)


def test_feed_matches_at_random(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abc") for _ in range(r.randint(1, n)))
    products = [(i, r.choice([None, word(6)]), r.choice([None, word(3)]), f"{word(4)} {word(2)}", None, None) for i in range(60)]
    items = [(i, " ".join(word(7) for _ in range(r.randint(0, 4))), None) for i in range(80)]
    got = [tuple(x) for x in feed_matches(spark.createDataFrame(products, "row_idx long, sku string, brand string, title string, ean string, gtin string"), spark.createDataFrame(items, "item_idx long, title string, ean string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p[0], i[0]) for p in products for i in items if in_feed(p, i)}


def test_addresses(spark):
    def plain(value):
        at = urlsplit(value.strip())
        names = sorted((k, v) for k, v in parse_qsl(at.query) if k.lower() not in offers.TRACKING and not k.lower().startswith("utm_"))
        return f"{at.scheme or 'https'}://{at.netloc.lower().removeprefix('www.')}{at.path.rstrip('/') or '/'}{'?' + urlencode(names) if names else ''}"

    given = ["HTTPS://www.Shop.it/P/1/?b=2&a=1#x", "shop.it/x", "//h.it", "http://a.it?z=%C3%A9+x&z=a%20b&y=&q", "http://a.it/?=v&k=a=b&UTM_X=1&Ref=2&tag=&m=~*!", " https://u:p@w.it:8080/a//?x=%zz ", "mailto:a@b.it", "http://a.it/?b=1&B=2&a=%2F"]
    rows = spark.createDataFrame([(x,) for x in [*given, None, "http://[bad "]], "u string").select("u", offers.url("u").alias("got")).collect()
    assert {r.u: r.got for r in rows} == {x: plain(x) for x in given} | {None: None, "http://[bad ": "http://[bad"}


def test_meaning_leaves_out_what_is_settled(spark):
    catalog = spark.createDataFrame([(1, "red lamp", None), (2, "red lamp", None)], "row_idx long, title string, category string").withColumn("brand", F.lit("x"))
    found = spark.createDataFrame([(1, "a", "red lamp"), (2, "b", "red lamp")], "row_idx long, source_id string, title string").withColumn("brand", F.lit("x"))
    prior = spark.createDataFrame([(1, 1, 0.95)], "catalog_idx long, offer_idx long, confidence double")
    pairs = lambda by: {(r.catalog_idx, r.offer_idx) for r in matching.semantic(catalog, found, prior, 0.6, by_pair=by).collect()}
    assert pairs(False) == {(2, 1), (2, 2)} and pairs(True) == {(1, 2), (2, 1), (2, 2)}


def test_a_further_layer(spark):
    catalog = spark.createDataFrame([(1, "red lamp", None, "x", "A1", None, None)], "row_idx long, title string, category string, brand string, sku string, ean string, gtin string")
    found = spark.createDataFrame([(1, "s", "a", "blue chair", "x", None, None, None)], "row_idx long, source string, source_id string, title string, brand string, sku string, ean string, gtin string")

    def same_brand(products, others, prior):
        pairs = products.select(F.col("row_idx").alias("catalog_idx"), "brand").join(others.select(F.col("row_idx").alias("offer_idx"), "brand"), "brand")
        return pairs.select(*matching.candidate("semantic", F.lit(0.65), F.lit("SAME_BRAND"))).withColumn("layer_source", F.lit("brand"))

    best = cascade.link(catalog, found, layers=[same_brand]).best.first()
    assert (best.match_method, best.layer_ord, best.confidence) == ("SAME_BRAND", 3, 0.65) and cascade.link(catalog, found).accepted.isEmpty()


def test_pairs_met_by_sku_come_first_among_equals(spark):
    offers_ = spark.createDataFrame([(1, "s", "a", None), (2, "s", "b", "K1")], "row_idx long, source string, source_id string, sku string")
    found = spark.createDataFrame([(9, 1, 0.75, 2), (9, 2, 0.75, 2)], "catalog_idx long, offer_idx long, confidence double, layer_ord int")
    best = matching.judged(matching.deduplicated(found, offers_)).where("cand_rank = 1").first()
    assert best.offer_idx == 2


def test_a_bad_file_gives_no_offers(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,title,price\n1,t,ask\n")
    (tmp_path / "good.csv").write_text("id,title,price\n1,t,\"5,00\"\n")
    assert [files.pool(spark, str(tmp_path / f)).count() for f in ("bad.csv", "none.csv", "good.csv")] == [0, 0, 1]


def test_facts_of_page():
    page = '<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Org"},{"@graph":[{"@type":["x","product"],"gtin8":"1","offers":[{"lowPrice":5,"shippingDetails":{"shippingRate":{"value":0}}}]}]}]</script>'
    facts = pages.facts_of(page)
    assert (facts["gtin"], facts["price"], facts["shipping"]) == ("1", "5", "0") and pages.facts_of(None) == {}
