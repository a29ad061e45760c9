"""Answers of search providers and merchant feeds as raw hits.

Each function takes a table with catalog_idx and the answer's JSON in ``body``, and returns hits:
catalog_idx, hit_idx, source_provider, title, url, snippet, price, currency, shipping_cost, ean. Bodies that are
no JSON give no hits. Fetching them is outside: any Spark source that yields bodies serves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers, money
from ..functions.money import MONEY
from ..operators.offers import feed_choice, feed_matches
from ..operators.shared import stored
from .files import numbered

#: Providers by what a search costs; the free ones come first.
TIERS = {"searxng": 0, "duckduckgo": 0, "trovaprezzi": 0, "ebay": 0, "feed": 0, "csv": 0, "dataforseo": 1, "serper": 1, "keepa": 1}
#: Hits of a product's one provider are numbered below this.
HITS_MOST = 1 << 40


def together(found: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All providers' hits, given as (provider, hits), numbered in the order of cost, provider and hit.

    Providers of one cost keep the order they are given in. Columns that a provider lacks are null.
    """
    ordered = sorted(found, key=lambda pair: TIERS.get(pair[0], 0))
    rows = [df.withColumn("hit_idx", F.col("hit_idx") + F.lit(k * HITS_MOST)) for k, (_, df) in enumerate(ordered)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return out.select("*", *(F.lit(None).cast("string").alias(c) for c in ("ean", "sku", "brand") if c not in out.columns))


def hits(df: DataFrame, provider: str, title: Column, url: Column, snippet: Column | None = None, price: Column | None = None, currency: Column | None = None, shipping: Column | None = None, ean: Column | None = None, titled: bool = True) -> DataFrame:
    empty = F.lit(None).cast("string")
    col = lambda c, kind="string": (empty if c is None else c).cast(kind)
    out = df.select("catalog_idx", F.col("hit_idx").cast("long"), F.lit(provider).alias("source_provider"), title.alias("title"), url.alias("url"), col(snippet).alias("snippet"), col(price, MONEY).alias("price"), col(currency).alias("currency"), col(shipping, MONEY).alias("shipping_cost"), col(ean).alias("ean"))
    return out.where("coalesce(url, '') <> ''").where(F.lit(not titled) | (F.coalesce("title", F.lit("")) != ""))


def first_hits(found: DataFrame, most: int) -> DataFrame:
    """The first hits of each product's search."""
    place = F.row_number().over(Window.partitionBy("catalog_idx").orderBy("hit_idx"))
    return found.withColumn("place_", place).where(F.col("place_") <= most).drop("place_")


def items(answers: DataFrame, schema: str, *path: str) -> DataFrame:
    """One row ``x`` for each element at the path of arrays, with hit_idx in order; of several bodies of a
    product in the order of their ``place``, where they have one."""
    order = ["place"] if "place" in answers.columns else []
    rows = answers.select("catalog_idx", *order, F.from_json("body", schema).alias("x"))
    for k, step in enumerate(path):
        rows = rows.select("catalog_idx", *order, F.posexplode(f"x.{step}").alias(f"p{k}", "x"))
        order.append(f"p{k}")
    if len(path) == 1:
        first = F.col("place") * (1 << 20) if "place" in order else F.lit(0)
        return rows.withColumn("hit_idx", first + F.col("p0").cast("long"))
    return rows.withColumn("hit_idx", F.row_number().over(Window.partitionBy("catalog_idx").orderBy(*order)).cast("long") - 1)


def searxng(answers: DataFrame, market: str = "IT") -> DataFrame:
    """Web results; a stated price, else one read from the snippet; an address counts once."""
    rows = items(answers, "struct<results:array<struct<title:string,url:string,content:string,price:string>>>", "results")
    found = F.coalesce(money.price(F.col("x.price"), F.lit(market)), money.snippet_price(F.concat_ws(" ", "x.title", "x.content"), F.lit(market)))
    out = hits(rows, "searxng", F.col("x.title"), F.col("x.url"), F.col("x.content"), found, F.lit("EUR"))
    first = out.groupBy("catalog_idx", "url").agg(F.min("hit_idx").alias("hit_idx"))
    return out.join(first, ["catalog_idx", "url", "hit_idx"], "left_semi")


def ebay(answers: DataFrame) -> DataFrame:
    rows = items(answers, "struct<itemSummaries:array<struct<title:string,itemWebUrl:string,price:struct<value:string,currency:string>,shippingOptions:array<struct<shippingCost:struct<value:string>>>,epid:string,gtin:string>>>", "itemSummaries")
    shipping = F.get(F.col("x.shippingOptions"), 0)["shippingCost"]["value"].try_cast(MONEY)
    return hits(rows, "ebay", F.col("x.title"), F.col("x.itemWebUrl"), None, F.col("x.price.value").try_cast(MONEY), F.col("x.price.currency"), shipping, F.col("x.gtin"))


def dataforseo(answers: DataFrame, result_limit: int = 20) -> DataFrame:
    """Three nested lists; only answers of status 20000 count, only items with a price, the first of a search."""
    good = answers.where(F.get_json_object("body", "$.status_code") == "20000")
    rows = items(good, "struct<tasks:array<struct<result:array<struct<items:array<struct<title:string,url:string,description:string,price:string,currency:string>>>>>>>", "tasks", "result", "items")
    price = F.coalesce(F.col("x.price").try_cast(MONEY), F.get_json_object("x.price", "$.current").try_cast(MONEY))
    currency = F.coalesce("x.currency", F.get_json_object("x.price", "$.currency"))
    return first_hits(hits(rows, "dataforseo", F.col("x.title"), F.col("x.url"), F.col("x.description"), price, currency).where("price is not null"), max(1, result_limit))


def serper(answers: DataFrame, market: str = "IT") -> DataFrame:
    """Shopping tiles with a price, in words or as a number; without a sign it is in euro."""
    rows = items(answers, "struct<shopping:array<struct<title:string,link:string,price:string,priceValue:string,delivery:string,source:string>>>", "shopping")
    sign = F.when(F.contains("x.price", F.lit("€")), "EUR").when(F.contains("x.price", F.lit("£")), "GBP").when(F.contains("x.price", F.lit("$")), "USD").otherwise("EUR")
    delivery = F.lower(F.col("x.delivery"))
    shipping = F.when(delivery.rlike("free|gratis|gratuit"), F.lit(0).cast(MONEY)).otherwise(money.loose_price(F.regexp_extract(F.col("x.delivery"), r"\d+(?:[.,]\d+)*", 0)))
    price = F.coalesce(money.loose_price(F.col("x.price")), money.loose_price(F.col("x.priceValue")))
    return hits(rows, "serper", F.trim("x.title"), F.trim("x.link"), None, price, sign, shipping).where("price is not null")


#: What the end of an Amazon address says of its prices, where that is not the euro.
AMAZON_MONEY = {"co.uk": "GBP", "com": "USD"}


def keepa(answers: DataFrame, tld: str = "it") -> DataFrame:
    """Cents of the current price; none or less is no offer. The barcode is the one asked for, where answers have it in
    ``code``, else the first that the answer lists."""
    rows = items(answers, "struct<products:array<struct<asin:string,title:string,stats:struct<current:array<long>>,eanList:array<string>>>>", "products")
    price = (F.get(F.col("x.stats.current"), 0) / 100).cast(MONEY)
    listed = F.get(F.col("x.eanList"), 0)
    if "code" in answers.columns:
        rows = rows.join(answers.groupBy("catalog_idx").agg(F.min("code").alias("code_")), "catalog_idx", "left")
        listed = F.coalesce("code_", listed)
    asin = F.nullif(F.trim("x.asin"), F.lit(""))
    return hits(rows, "keepa", F.trim("x.title"), F.concat(F.lit(f"https://www.amazon.{tld}/dp/"), asin), None, F.when(price > 0, price), F.lit(AMAZON_MONEY.get(tld, "EUR")), None, listed).where("price is not null")


FEED = "title string, link string, `g:price` string, `g:gtin` string, `g:availability` string, `g:shipping` struct<`g:price`:string>, `g:shipping_price` string, `g:brand` string, `g:mpn` string"


def merchant_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds with g: fields: title, url, price, currency, shipping_cost, ean, item_idx.

    ``path`` may be a folder or pattern. An item that is no XML is passed over, and so is a path without feeds; a
    shipping node counts before the flat field, even where it states no cost. item_idx is unique, and follows the
    items' order in a file. Items after the place where a file is broken are lost, those before it stay.
    """
    try:
        rows = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(FEED).load(path)
    except AnalysisException:
        rows = spark.createDataFrame([], FEED)
    currency = F.nullif(F.regexp_extract(F.col("`g:price`"), r"\b([A-Z]{3})\b", 1), F.lit(""))
    shipping = F.when(F.col("`g:shipping`").isNotNull(), F.col("`g:shipping`")["g:price"]).otherwise(F.col("`g:shipping_price`"))
    return rows.select(
        F.monotonically_increasing_id().alias("item_idx"), F.trim("title").alias("title"), F.trim("link").alias("url"), money.loose_price(F.col("`g:price`")).alias("price"), F.coalesce(currency, F.lit("EUR")).alias("currency"), money.loose_price(shipping).alias("shipping_cost"),
        identifiers.gtin(F.col("`g:gtin`")).alias("ean"), F.col("`g:brand`").alias("brand"), F.col("`g:mpn`").alias("sku"),
    ).where("coalesce(title, '') <> '' and coalesce(url, '') <> ''")


def feed_hits(catalog: DataFrame, feed: DataFrame, alone: bool = False) -> DataFrame:
    """Hits of each product among a feed's items, in the items' order, as ``together`` takes them.

    The feed is stored once with its items numbered from 0 on, so it is neither read nor parsed again. Where the feed is
    ``alone``, with no other provider's hits beside its own, hits that cannot become an offer are not made.
    """
    items_ = stored(numbered(feed.withColumnRenamed("item_idx", "row_idx")).withColumn("item_idx", F.col("number") - 1).drop("row_idx", "number"))
    found = (feed_choice if alone else feed_matches)(catalog, items_).join(items_, "item_idx").withColumn("hit_idx", F.col("item_idx"))
    return hits(found, "feed", F.col("title"), F.col("url"), None, F.col("price"), F.col("currency"), F.col("shipping_cost"), F.col("ean"))
