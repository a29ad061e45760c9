"""Places within groups, one of which holds a third of all rows, and the landscape of such a product."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from linkwright.operators import landscape, matching, ordering


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n):
    """(g, price, id): every third row is of one group, and prices repeat or are missing."""
    pick = random.Random(seed)
    return [(0 if i % 3 == 0 else pick.randrange(1, 200), pick.choice([None, 5, 5, pick.randrange(50)]), i) for i in range(n)]


def test_places_and_counts(spark, many_parts):
    rows = rows_of(1, 6000)
    order = (F.col("price").asc_nulls_last(), F.col("id").asc())
    df = spark.createDataFrame(rows, "g long, price long, id long").repartition(5)
    by_group = {}
    for g, price, i in sorted(rows, key=lambda r: (r[1] is None, r[1], r[2]) if r[1] is not None else (True, 0, r[2])):
        by_group.setdefault(g, []).append((price, i))
    want = {i: (k, sum(p is not None for p, _ in members)) for members in by_group.values() for k, (_, i) in enumerate(members, 1)}
    got = {r.id: (r.place, r.n) for r in ordering.placed(df, ["g"], order, {"n": F.col("price")}).collect()}
    assert got == want
    sizes = [r["count"] for r in ordering.parted(df, ["g"], order).groupBy("part_").count().collect()]
    hot = ordering.parted(df, ["g"], order).where("g = 0").select("part_").distinct().count()
    assert hot >= 3 and max(sizes) <= 2 * median(sizes)


def test_no_rows(spark):
    assert ordering.placed(spark.createDataFrame([], "g long, id long"), ["g"], [F.col("id").asc()], {"n": F.col("id")}).collect() == []


def test_ranks_dealt_are_those_of_a_window(spark, many_parts):
    pick = random.Random(2)
    rows = [(0 if i % 3 == 0 else i % 40, i, pick.randrange(11) / 10, (pick.randrange(3), i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "catalog_idx long, offer_idx long, confidence double, first_met struct<layer_ord:int,offer_idx:long>")
    key = ["catalog_idx", "offer_idx", "status", "cand_rank", "confidence_level"]
    both = [sorted(tuple(r) for r in matching.judged(df, dealt=d).select(*key).collect()) for d in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 3000


def test_landscape_of_a_hot_product(spark, many_parts):
    pick = random.Random(3)
    priced = [None if i % 17 == 0 else round(pick.randrange(1000, 90000) / 100, 2) for i in range(2000)]
    product = [0 if i % 3 == 0 else 1 + i % 25 for i in range(2000)]
    offers = spark.createDataFrame([(i, "feed", f"s{i}", f"shop{i}", f"https://a.it/{i}", p) for i, p in enumerate(priced)], "row_idx long, source string, source_id string, seller string, url string, p double").select(
        "*", F.col("p").cast("decimal(18,4)").alias("price"), F.lit(0).cast("decimal(18,4)").alias("shipping_cost"), F.lit(False).alias("vat_included"), F.lit("IT").alias("market"), F.lit("IN_STOCK").alias("availability"), F.lit(None).cast("int").alias("stock_quantity")
    )
    catalog = spark.createDataFrame([(i, f"k{i}", "t", "b") for i in range(27)], "row_idx long, sku string, title string, brand string").select("*", F.lit(500).cast("decimal(18,4)").alias("price"), F.lit(1).cast("decimal(18,4)").alias("cogs"))
    accepted = spark.createDataFrame([(p, i, 0.95, "exact_id", i) for i, p in enumerate(product)], "catalog_idx long, offer_idx long, confidence double, layer_source string, cand_rank int").withColumn("details", F.lit(None).cast(matching.DETAILS))
    got = {r.catalog_idx: r for r in landscape.summary(catalog, accepted, offers).collect()}
    places = {(r.catalog_idx, r.offer_idx): r.place for r in landscape.landscape_rows(catalog, accepted, offers).collect()}
    assert places[26, None] == 1 and got[26].n_competitor == 0 and got[26].min_landed is None
    for k in range(26):
        own = sorted(((priced[i] is None, priced[i] or 0, i) for i, p in enumerate(product) if p == k))
        known = [x for none, x, _ in own if not none]
        assert [places[k, i] for *_, i in own] == list(range(1, len(own) + 1))
        r = got[k]
        assert (r.n_competitor, float(r.min_landed), float(r.max_landed), r.cheapest_competitor, r.position) == (len(own), known[0], known[-1], f"shop{own[0][2]}", 1 + sum(x < 500 for x in known))
        assert abs(float(r.median_landed) - median(known)) <= 0.0051
