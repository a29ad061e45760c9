"""A catalog and offers derived from the star schema's tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Twelve digits of a barcode, and its check digit appended.
PAYLOAD = "concat('20', lpad(cast(p_partkey as string), 10, '0'))"
SUM = " + ".join(f"{3 if i % 2 == 0 else 1} * cast(substr({PAYLOAD}, {i}, 1) as int)" for i in range(1, 13))
EAN = f"concat({PAYLOAD}, cast((10 - ({SUM}) % 10) % 10 as string))"
STOCK_UNIT = "concat('P', lpad(cast(p_partkey as string), 6, '0'))"
#: Products with both, made once for each and not for each of its offers.
PARTS = f"(SELECT *, {EAN} AS p_ean, {STOCK_UNIT} AS p_sku FROM {{part}}) AS parts"
MARKET = "CASE cast(l_suppkey % 10 as int) WHEN 0 THEN 'IT' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'ES' WHEN 4 THEN 'NL' WHEN 5 THEN 'PT' WHEN 6 THEN 'BE' WHEN 7 THEN 'AT' WHEN 8 THEN 'UK' ELSE 'US' END"
CENTS = "(cast(round(p_retailprice * 100, 0) as bigint) + l_orderkey % 500)"
#: One line for each number of an order; the table repeats some.
LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS lines"

CATALOG = f"""
SELECT cast(p_partkey as bigint) AS row_idx, p_sku AS sku, p_brand AS brand, p_name AS title, p_type AS category, 'IT' AS market, p_ean AS ean, p_ean AS gtin,
       cast(p_retailprice as decimal(18,4)) AS price, cast(cast(round(p_retailprice * 100, 0) as bigint) * 9 / 1000.0 as decimal(18,4)) AS cogs, 'EUR' AS currency
FROM {PARTS}
"""
OFFERS = f"""
SELECT cast(l_orderkey * 10 + l_linenumber as bigint) AS row_idx, CASE WHEN l_orderkey % 3 = 0 THEN 'feed' ELSE 'oxylabs' END AS source, concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS source_id, p_name AS title,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE {CENTS} END AS price_cents, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE cast({CENTS} / 100.0 as decimal(18,4)) END AS price, 'EUR' AS currency,
       concat('https://www.supplier', cast(l_suppkey as string), '.it/p/', cast(p_partkey as string), '/?utm_source=x&color=', cast(l_orderkey % 3 as string), '#top') AS url, {MARKET} AS market,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE p_ean END AS ean, CASE WHEN l_linenumber % 6 = 0 THEN p_ean ELSE NULL END AS gtin,
       CASE WHEN l_orderkey % 5 < 3 THEN NULL WHEN l_orderkey % 2 = 0 THEN concat(p_sku, 'X') ELSE p_sku END AS sku, CASE WHEN l_orderkey % 11 = 0 THEN 'Other' WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE cast(l_orderkey % 3 as int) WHEN 0 THEN cast(NULL as decimal(18,4)) WHEN 1 THEN cast(0 as decimal(18,4)) ELSE cast(4.99 as decimal(18,4)) END AS shipping_cost,
       CASE cast(l_orderkey % 4 as int) WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS vat_included, 'IN_STOCK' AS availability, cast(NULL as int) AS stock_quantity, cast(NULL as string) AS shipping_source, s_name AS seller
FROM {LINES} JOIN {PARTS} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey
"""
#: Candidates of which many tie, to try the choice among them.
CANDIDATES = f"""
SELECT cast(l_partkey as bigint) AS catalog_idx, cast(l_orderkey * 10 + l_linenumber as bigint) AS offer_idx, cast(cast(l_quantity as int) % 10 as double) / 10 AS confidence, cast(l_suppkey % 3 as int) AS layer_ord,
       CASE cast(l_suppkey % 3 as int) WHEN 0 THEN 'exact_id' WHEN 1 THEN 'sku_brand' ELSE 'semantic' END AS layer_source, CASE WHEN l_orderkey % 3 = 0 THEN 'feed' ELSE 'oxylabs' END AS source, cast(l_orderkey % 7 as string) AS source_id
FROM {LINES}
"""
#: Hits of providers: a product's offers under addresses that differ only in what tracks.
HITS = f"""
SELECT cast(l_partkey as bigint) AS catalog_idx, cast(l_orderkey * 10 + l_linenumber as bigint) AS hit_idx, 'searxng' AS source_provider, concat('Offer ', p_name) AS title,
       concat('https://', CASE WHEN l_orderkey % 2 = 0 THEN 'www.' ELSE '' END, 'shop', cast(l_suppkey % 20 as string), '.it/p/', cast(l_partkey as string), '/?utm_source=x&color=', cast(l_orderkey % 2 as string)) AS url,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('code P', lpad(cast(l_partkey as string), 6, '0')) END AS snippet, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE cast(l_quantity as decimal(18,4)) END AS price, 'EUR' AS currency,
       CASE WHEN l_orderkey % 3 = 0 THEN cast(5 as decimal(18,4)) ELSE NULL END AS shipping_cost, cast(NULL as string) AS ean, cast(NULL as string) AS sku, cast(NULL as string) AS brand
FROM {LINES} JOIN {{part}} ON l_partkey = p_partkey
"""
TABLES = ("part", "lineitem", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def plain(sql: str) -> str:
    """The text for an engine that has the tables by name."""
    return sql.format(**{t: t for t in TABLES})
