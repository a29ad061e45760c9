"""Catalogs and offers from CSV files, with columns found by their aliases; landscapes to CSV files."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers, money, offers as offer_functions
from . import quoted

#: Column names under which a field may come, the first that is filled wins in each row.
CATALOG_COLUMNS = {
    "sku": ("sku", "product_sku", "code"),
    "ean": ("ean", "ean13", "barcode"),
    "gtin": ("gtin",),
    "brand": ("brand", "manufacturer", "marca"),
    "title": ("title", "name", "product_name", "titolo"),
    "category": ("category", "categoria", "cat"),
    "market": ("market", "country", "mercato"),
    "price": ("price", "our_price", "sell_price", "prezzo"),
    "cogs": ("cogs", "cost", "our_cogs", "costo"),
    "currency": ("currency", "valuta"),
}
OFFER_COLUMNS = {
    "source_id": ("product_id", "id", "asin", "result_id"),
    "title": ("title", "product_title", "name"),
    "brand": ("brand", "manufacturer"),
    "ean": ("ean", "barcode"),
    "gtin": ("gtin",),
    "sku": ("sku", "seller_sku"),
    "price": ("price", "price_value", "current_price"),
    "currency": ("currency", "price_currency"),
    "url": ("url", "product_url", "link"),
    "availability": ("availability", "stock", "stock_status", "in_stock", "disponibilita", "disponibilità"),
    "seller": ("seller", "retailer", "store", "shop", "merchant", "competitor_name"),
    "source": ("source", "provenance", "channel"),
    "scraped_at": ("scraped_at", "timestamp", "date", "crawled_at"),
}
SHIPPING_COLUMNS = ("shipping", "shipping_cost", "delivery", "delivery_cost")
MARKET_COLUMNS, URL_COLUMNS, CURRENCY_COLUMNS = ("market", "country", "mercato"), ("url", "product_url", "link"), ("currency", "price_currency", "valuta")


class InputError(ValueError):
    """A file that cannot be read, or rows without what they need."""


def delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def head(spark: SparkSession, path: str, chars: int = 8192) -> str:
    """The first characters of a file, of which no more than its first lines are read."""
    lines, size = [], 0
    for row in spark.read.text(path).toLocalIterator():
        lines.append(row.value)
        size += len(row.value) + 1
        if size >= chars:
            break
    return "\n".join(lines)[:chars]


def read_csv(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as strings, empty where missing, with row_idx in the order of files and rows.

    The delimiter is told from the file's head. Only that head goes to the driver. A quoted field may
    hold line breaks, and a file is many tasks all the same; without ``multi_line``, where no field does, texts
    are not moved, and row_idx leaves gaps.
    """
    sep = delimiter(head(spark, path)) if sep is None else sep
    if multi_line:
        df = quoted.read(spark, path, sep)
        return df.select(*(F.col(f"`{c}`").alias(c.strip()) for c in df.columns))
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', mode="FAILFAST").na.fill("")
    return df.select(*(F.col(f"`{c}`").alias(c.strip()) for c in df.columns)).withColumn("row_idx", F.monotonically_increasing_id())


def field(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """The first filled alias of a row, names in any case."""
    names = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.col(f"`{names[a]}`"), F.lit("")) for a in aliases if a in names]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def required(df: DataFrame, names: tuple[str, ...], shown: int = 10) -> DataFrame:
    """df, unless a row lacks one of the names: a bad row is an error, never dropped."""
    missing = df.where(" or ".join(f"coalesce(trim({n}), '') = ''" for n in names)).select("row_idx").limit(shown).collect()
    if missing:
        raise InputError(f"{', '.join(names)} needed; rows {[r.row_idx for r in missing]}")
    return df


def catalog(raw: DataFrame, market: str = "IT") -> DataFrame:
    """Products from raw rows; columns of no field stay in attributes."""
    c = {k: field(raw, v) for k, v in CATALOG_COLUMNS.items()}
    used = {a for v in CATALOG_COLUMNS.values() for a in v}
    rest = [x for x in raw.columns if x.lower() not in used and x != "row_idx"]
    attributes = F.map_filter(F.create_map(*(y for x in rest for y in (F.lit(x), F.col(f"`{x}`")))), lambda _, v: v != "") if rest else F.create_map().cast("map<string,string>")
    place = F.coalesce(offer_functions.market_of_code(c["market"]), F.lit(market))
    out = raw.select(
        "row_idx", F.trim(c["sku"]).alias("sku"), F.trim(c["brand"]).alias("brand"), F.trim(c["title"]).alias("title"), F.trim(c["category"]).alias("category"), place.alias("market"), identifiers.ean(identifiers.barcode(c["ean"])).alias("ean"),
        identifiers.gtin(identifiers.barcode(c["gtin"])).alias("gtin"), money.price(c["price"], place).alias("price"), money.price(c["cogs"], place).alias("cogs"), c["currency"].alias("currency"), attributes.alias("attributes"),
    )
    return required(out, ("sku", "title", "brand"))


def numbered(df: DataFrame, bits: int = 20) -> DataFrame:
    """df with number: the place, from 1, in the order of row_idx.

    Rows are ranked within ranges of 2^bits ids; only the ranges' counts are summed up in one task.
    """
    rows = df.withColumn("range_", F.shiftright("row_idx", bits))
    counts = rows.groupBy("range_").agg(F.count("*").alias("n_"))
    before = counts.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    rank = F.row_number().over(Window.partitionBy("range_").orderBy("row_idx"))
    return rows.withColumn("rank_", rank).join(before, "range_").withColumn("number", F.col("before_") + F.col("rank_")).drop("range_", "rank_", "before_")


def offers(raw: DataFrame, market: str = "IT") -> DataFrame:
    """Offers from raw rows; the market is the run's. A price that cannot be read is an error."""
    c = {k: field(raw, v) for k, v in OFFER_COLUMNS.items()}
    names = {x.lower(): x for x in raw.columns}
    shipping = F.coalesce(*(F.when(F.trim(F.col(f"`{names[a]}`")) != "", F.col(f"`{names[a]}`")) for a in SHIPPING_COLUMNS if a in names), F.lit(None).cast("string"))
    unnamed = raw.where(c["source_id"].isNull()).limit(1).count() > 0
    ident = F.coalesce(c["source_id"], F.concat(F.lit("row-"), F.col("number_").cast("string"))) if unnamed else c["source_id"]
    rows = raw.join(numbered(raw.select("row_idx")).select("row_idx", F.col("number").alias("number_")), "row_idx") if unnamed else raw
    place = F.lit(market)
    out = rows.select(
        "row_idx", F.lower(F.coalesce(c["source"], F.lit("oxylabs"))).alias("source"), ident.alias("source_id"), F.trim(c["title"]).alias("title"), money.price(c["price"], place).alias("price"), c["price"].alias("price_text"), F.coalesce(c["currency"], F.lit("EUR")).alias("currency"),
        F.coalesce(c["url"], F.lit("")).alias("url"), place.alias("market"), identifiers.ean(c["ean"]).alias("ean"), identifiers.gtin(c["gtin"]).alias("gtin"), c["sku"].alias("sku"), c["brand"].alias("brand"), money.loose_price(shipping).alias("shipping_cost"), F.lit(None).cast("string").alias("shipping_source"),
        F.lit(None).cast("boolean").alias("vat_included"), F.lit(None).cast("int").alias("stock_quantity"), offer_functions.availability(c["availability"]).alias("availability"), c["seller"].alias("seller"), c["scraped_at"].alias("scraped_at"),
        F.create_map(*(y for x in raw.columns if x != "row_idx" for y in (F.lit(x), F.col(f"`{x}`")))).alias("raw_data"),
    )
    required(out, ("title", "price_text"))
    return required(out.withColumn("price_text", F.col("price").cast("string")), ("price_text",)).drop("price_text")


def pool(spark: SparkSession, path: str, market: str = "IT") -> DataFrame:
    """Offers of a file, none where it is missing or has a row that cannot be read: one of several sources may fail. That a
    job fails for another reason, such as lost executors, is an error."""
    try:
        return offers(read_csv(spark, path), market)
    except (InputError, AnalysisException):
        return none(spark, market)
    except PySparkException as e:
        if "MALFORMED" not in str(e):
            raise
        return none(spark, market)


def none(spark: SparkSession, market: str) -> DataFrame:
    return offers(spark.createDataFrame([], "title string, price string, row_idx long"), market)


def votes(rows: DataFrame) -> DataFrame:
    """market, n: the most frequent market, the earlier one of equals."""
    counts = rows.where("market is not null").groupBy("market").agg(F.count("*").alias("n"), F.min("row_idx").alias("i"))
    return counts.orderBy(F.col("n").desc(), "i").limit(1).select("market", "n")


def vote(rows: DataFrame) -> str | None:
    best = votes(rows).first()
    return None if best is None else best.market


def detect_market(catalog_rows: DataFrame, offer_rows: DataFrame | None = None) -> str:
    """By the catalog's market column, else by the addresses' domains, else by the currencies, else IT."""
    found = vote(catalog_rows.select("row_idx", offer_functions.market_of_code(field(catalog_rows, MARKET_COLUMNS)).alias("market")))
    if found is None and offer_rows is not None:
        currency = F.upper(F.trim(field(offer_rows, CURRENCY_COLUMNS)))
        found = vote(offer_rows.select("row_idx", offer_functions.market_of_url(field(offer_rows, URL_COLUMNS)).alias("market"))) or vote(offer_rows.select("row_idx", F.when(currency == "GBP", "UK").when(currency == "USD", "US").alias("market")))
    return found or "IT"


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One folder of CSV files with headers, which in the order of their names hold the rows in that of ``order``."""
    write_results(df.sparkSession, path, {"": (df, order)})


def write_results(spark: SparkSession, path: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> None:
    """Tables, each with its order, as folders of CSV files in a folder that takes the place of ``path`` when all are written.

    Rows are sorted by ranges, so no task holds a whole table. A run that ends early leaves what stood at ``path``, and a
    folder beside it whose name begins with its own. Until the new folder is in its place the old one is
    kept beside it, and is put back where the move fails.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = lambda word: spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{word}-{uuid.uuid4().hex}")
    new, old = beside("new"), beside("old")
    for name, (df, order) in tables.items():
        (df.orderBy(*order) if order else df).write.csv(f"{new}/{name}".rstrip("/"), header=True, quoteAll=False, escape='"')
    if kept := system.exists(place):
        if not system.rename(place, old):
            raise OSError(f"{path} cannot be moved")
    if not system.rename(new, place):
        if kept:
            system.rename(old, place)
        raise OSError(f"{new} cannot be moved to {path}")
    if kept:
        system.delete(old, True)


def write_landscape(path: str, rows: DataFrame, summary: DataFrame, statistics: DataFrame) -> None:
    """What a run gives, in the catalog's order: each product's offers from the cheapest on, its summary, and the run's numbers."""
    write_results(rows.sparkSession, path, {"landscape": (rows, ("catalog_idx", "place")), "summary": (summary, ("catalog_idx",)), "stats": (statistics, ("metric",))})


def write_matches(path: str, rows: DataFrame, statistics: DataFrame) -> None:
    """The result rows of all products in the catalog's order, and the run's numbers."""
    write_results(rows.sparkSession, path, {"matches": (rows, ("catalog_idx",)), "stats": (statistics, ("metric",))})
