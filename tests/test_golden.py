"""The whole offline run on a made catalog, against a comparison of all pairs in plain Python."""

import pytest

from linkwright.operators import matching
from linkwright.plans import cascade
from linkwright.sources import files

MAKERS = ("Arbora", "Belfiore", "Cantiere", "Dorsale", "Elmwood", "Ferrovia")
GOODS = (("pruning saw", "SW"), ("garden hose", "GH"), ("rain barrel", "RB"), ("leaf rake", "LR"))


def barcode(payload):
    digits = f"{payload:012d}"
    return digits + str(-sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10)


def made_products():
    """sku, ean, brand, title: each maker's goods, with SKUs that are far from the others of their maker."""
    for m, maker in enumerate(MAKERS):
        for g, (good, code) in enumerate(GOODS):
            n = m * len(GOODS) + g
            yield f"{code * 2}-{(n + 7) * 7919 % 90000 + 10000}-{chr(65 + n) * 3}", barcode(261000000000 + n * 104729), maker, f"{maker} {good} model {n + 1}"


PRODUCTS = list(made_products())
BY_SKU = {sku for i, (sku, *_) in enumerate(PRODUCTS) if i % 3 == 0}


def made_offers():
    """source_id, title, brand, ean, sku, price: one for each product, every third of them with its SKU, and three odd ones."""
    for i, (sku, ean, maker, title) in enumerate(PRODUCTS):
        yield f"M{i:03d}", f"{title} new", maker, ean, sku if sku in BY_SKU else "", f"1.{100 + i},50"
    yield "X1", "Cover for a saw", "Otherwise", PRODUCTS[0][1], "", "12,90"
    yield "X2", "Rake, as new", PRODUCTS[3][2], "", PRODUCTS[3][0].replace("-", ""), "30,00"
    yield "X3", "HDMI cable 3 m", "Nobody", "", "", "7,20"


OFFERS = list(made_offers())


def ratio(a, b):
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return 2 * row[-1] / (len(a) + len(b))


def all_pairs():
    """sku -> its accepted offers as (source_id, confidence, method), without meaning: every product is settled before it."""
    found = {}
    for sku, ean, maker, _ in PRODUCTS:
        for source_id, _, brand, offer_ean, offer_sku, _ in OFFERS:
            scores = []
            if ean == offer_ean:
                scores.append((0.95 if brand == maker else 0.70, "EXACT_EAN"))
            if offer_sku:
                scores.append((round(ratio(sku, offer_sku) * (1.0 if brand == maker else 0.3), 4), "SKU_BRAND"))
            score, method = max(scores, key=lambda s: s[0], default=(0.0, ""))
            if score >= 0.60:
                found.setdefault(sku, set()).add((source_id, score, method))
    return found


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("golden")
    (folder / "c.csv").write_text("sku,ean,brand,title,category,market\n" + "".join(f"{s},{e},{b},{t},Garden,IT\n" for s, e, b, t in PRODUCTS))
    (folder / "o.csv").write_text("product_id;title;brand;ean;sku;price;currency;shipping\n" + "".join(f'{i};"{t}";{b};{e};{s};{p};EUR;0,00\n' for i, t, b, e, s, p in OFFERS))
    catalog, offers = files.catalog(files.read_csv(spark, str(folder / "c.csv"))), files.offers(files.read_csv(spark, str(folder / "o.csv")))
    return catalog, offers, cascade.link(catalog, offers)


def test_make_up():
    pairs = all_pairs()
    assert len(PRODUCTS) == len(pairs) == 24 and len(BY_SKU) == 8 and len(OFFERS) == 27
    assert all(max(score for _, score, _ in rows) >= matching.CONFIDENT for rows in pairs.values())


def test_candidates_are_those_of_all_pairs(linked):
    catalog, _, found = linked
    got = {}
    for r in found.accepted.join(catalog.selectExpr("row_idx AS catalog_idx", "sku"), "catalog_idx").collect():
        got.setdefault(r.sku, set()).add((r.source_id, r.confidence, r.match_method))
    assert got == all_pairs()
    assert ("X1", 0.7, "EXACT_EAN") in got[PRODUCTS[0][0]] and any(i == "X2" and m == "SKU_BRAND" for i, _, m in got[PRODUCTS[3][0]])
    assert "X3" not in {i for rows in got.values() for i, *_ in rows}


def test_best_matches(linked):
    catalog, _, found = linked
    best = {r.sku: (r.source_id, r.match_method, r.confidence_level) for r in found.best.join(catalog.selectExpr("row_idx AS catalog_idx", "sku"), "catalog_idx").collect()}
    assert best == {p[0]: (f"M{i:03d}", "SKU_BRAND" if p[0] in BY_SKU else "EXACT_EAN", "HIGH") for i, p in enumerate(PRODUCTS)}


def test_prices_are_read(linked):
    _, offers, _ = linked
    assert {r.source_id: float(r.price) for r in offers.collect()} == {i: float(p.replace(".", "").replace(",", ".")) for i, *_, p in OFFERS}


def test_all_pairs_of_skus_are_not_made(linked):
    catalog, offers, found = linked
    plan = matching.sku_brand(catalog, offers)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
