"""The queries over whole tables for each operator of product matching, and their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers, money, offers as offer_functions, text
from .operators import landscape, matching, models, offers as offer_operators, pages
from .operators.shared import new_folder, stored
from .plans import cascade, online
from .plans.workload import CANDIDATES, CATALOG, HITS, OFFERS, derived, plain, table
from .sources import fetching, files, page_fetching, providers, result_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = f"WITH catalog AS ({plain(CATALOG)}), offers AS ({plain(OFFERS)})"
EXACT_SQL = """exact_ AS (
  SELECT c.row_idx AS catalog_idx, o.row_idx AS offer_idx, 'EXACT_EAN' AS match_method, o.ean AS identifier, coalesce(lower(c.brand) <> lower(o.brand), false) AS conflict FROM catalog c JOIN offers o ON c.ean = o.ean
  UNION ALL
  SELECT c.row_idx, o.row_idx, 'EXACT_GTIN', o.gtin, coalesce(lower(c.brand) <> lower(o.brand), false) FROM catalog c JOIN offers o ON c.gtin = o.gtin WHERE (c.ean = o.ean) IS NOT TRUE
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, sf_dir, CATALOG), derived(spark, sf_dir, OFFERS)


def stored_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as tables, as a catalog and offers are: derived once, however often a query reads them."""
    return tuple(map(stored, inputs(spark, sf_dir)))


def exact_accepted(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    return matching.judged(matching.deduplicated(matching.exact_id(catalog, offers), offers)).where("status = 'accepted'")


RATE = "CASE market WHEN 'IT' THEN 22 WHEN 'DE' THEN 19 WHEN 'FR' THEN 20 WHEN 'ES' THEN 21 WHEN 'NL' THEN 21 WHEN 'PT' THEN 23 WHEN 'BE' THEN 21 WHEN 'AT' THEN 20 WHEN 'UK' THEN 20 ELSE 0 END"
#: In whole cents, half up.
LANDED_SQL = f"""rated AS (SELECT *, {RATE} AS rate FROM offers), priced AS (
  SELECT *, CASE WHEN coalesce(vat_included, true) THEN (2 * price_cents * 100 + 100 + rate) // (2 * (100 + rate)) ELSE price_cents END AS ex_cents, cast(coalesce(shipping_cost, 0) * 100 AS bigint) AS ship_cents FROM rated
), landed AS (SELECT *, ex_cents + ship_cents AS landed_cents FROM priced)"""
DECIMAL = "cast({} / 100.0 AS decimal(18,2))".format
SUMMARY_SQL = f"""{WITH}, {EXACT_SQL}, {LANDED_SQL}, rows_ AS (
  SELECT e.catalog_idx, e.offer_idx, o.landed_cents AS l, o.seller, o.url, row_number() OVER (PARTITION BY e.catalog_idx ORDER BY e.conflict, e.offer_idx) AS cand_rank FROM exact_ e JOIN landed o ON e.offer_idx = o.row_idx
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY catalog_idx ORDER BY l NULLS LAST, cand_rank) AS place, count(l) OVER (PARTITION BY catalog_idx) AS n FROM rows_
), per AS (
  SELECT p.catalog_idx, count(*) AS n_competitor, min(l) AS low, max(l) AS high, sum(CASE WHEN place BETWEEN (n + 1) // 2 AND n // 2 + 1 THEN l END)::BIGINT AS mid, CASE WHEN max(n) % 2 = 1 THEN 1 ELSE 2 END AS mid_n,
         max(CASE WHEN place = 1 AND l IS NOT NULL THEN seller END) AS cheapest_competitor, max(CASE WHEN place = 1 AND l IS NOT NULL THEN url END) AS cheapest_url, count(CASE WHEN l < c.price * 100 THEN 1 END) AS under
  FROM placed p JOIN catalog c ON p.catalog_idx = c.row_idx GROUP BY p.catalog_idx
), middle AS (SELECT *, CASE WHEN mid_n = 1 THEN mid WHEN mid % 2 = 0 THEN mid // 2 WHEN (mid // 2) % 2 = 0 THEN mid // 2 ELSE mid // 2 + 1 END AS median FROM per)
SELECT c.row_idx AS catalog_idx, c.sku AS product_sku, cast(c.price AS decimal(18,2)) AS our_price, coalesce(n_competitor, 0) AS n_competitor, {DECIMAL("low")} AS min_landed, {DECIMAL("median")} AS median_landed, {DECIMAL("high")} AS max_landed,
       cheapest_competitor, cheapest_url, CASE WHEN low IS NOT NULL THEN under + 1 END AS position, CASE WHEN low IS NOT NULL THEN greatest({DECIMAL("low")}, cast(round_even(c.cogs, 2) AS decimal(18,2))) END AS suggested_price
FROM catalog c LEFT JOIN middle m ON c.row_idx = m.catalog_idx
"""


@query(SUMMARY_SQL)
def landscape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return landscape.summary(catalog, exact_accepted(catalog, offers), offers)


@query(f"{WITH}, {EXACT_SQL} SELECT catalog_idx, offer_idx, CASE WHEN conflict THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence, match_method, identifier FROM exact_")
def exact_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_id(*inputs(spark, sf_dir)).select("catalog_idx", "offer_idx", "confidence", "match_method", F.col("details.identifier").alias("identifier"))


@query(f"{WITH}, {EXACT_SQL} SELECT lower(c.brand) AS brand, count(*) AS n FROM exact_ e JOIN catalog c ON e.catalog_idx = c.row_idx WHERE conflict GROUP BY ALL")
def exact_id_brand_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = inputs(spark, sf_dir)
    found = matching.exact_id(catalog, offers).where("details.brand_conflict")
    return found.join(catalog, F.col("catalog_idx") == F.col("row_idx")).groupBy(text.brand(F.col("brand")).alias("brand")).agg(F.count("*").alias("n"))


CODES = "CASE cast(l_orderkey % 4 as int) WHEN 0 THEN concat('0', lpad(cast(l_partkey as string), 7, '0')) WHEN 1 THEN lpad(cast(l_partkey * 7919 as string), 12, '3') WHEN 2 THEN concat('4-', lpad(cast(l_partkey * 31 + l_suppkey as string), 12, '0')) ELSE concat(' ', lpad(cast(l_orderkey as string), 14, '1')) END"
VALID = "({}) % 10 = 0".format(" + ".join(f"{3 if i % 2 else 1} * cast(substr(lpad({{0}}, 14, '0'), {i}, 1) as int)" for i in range(1, 15)))


@query(
    f"WITH c AS (SELECT l_orderkey, l_linenumber, {CODES} AS code FROM lineitem), d AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS g FROM c), e AS (SELECT *, CASE WHEN length(g) = 12 THEN concat('0', g) ELSE g END AS h FROM d) "
    f"SELECT l_orderkey, l_linenumber, CASE WHEN length(h) IN (8, 13) AND {VALID.format('h')} THEN h END AS ean, CASE WHEN length(g) IN (8, 12, 13, 14) AND {VALID.format('g')} THEN g END AS gtin FROM e"
)
def upc_gtin_not_equal_ean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CODES).alias("code"))
    return rows.select("l_orderkey", "l_linenumber", identifiers.ean(F.col("code")).alias("ean"), identifiers.gtin(F.col("code")).alias("gtin"))


#: The longest common subsequence goes line by line through its table, for pairs whose edit distance leaves the score open.
SKU_SQL = """named AS (SELECT row_idx, lower(brand) AS brand, upper(sku) AS sku FROM catalog WHERE sku <> ''), sold AS (SELECT row_idx, lower(brand) AS brand, upper(sku) AS sku FROM offers WHERE sku <> ''), near AS MATERIALIZED (
  SELECT a.sku AS a, b.sku AS b, a.brand AS a_brand, b.brand AS b_brand, CASE WHEN a.brand = b.brand THEN 1.0 ELSE 0.7 END::DOUBLE AS boost
  FROM (SELECT DISTINCT brand, sku FROM named) a JOIN (SELECT DISTINCT brand, sku FROM sold) b ON (a.brand = b.brand OR a.brand IS NULL OR b.brand IS NULL) AND levenshtein(a.sku, b.sku) <= (1 - 0.59995 / CASE WHEN a.brand = b.brand THEN 1.0 ELSE 0.7 END) * (length(a.sku) + length(b.sku)) + 1e-9
), alike AS MATERIALIZED (
  SELECT a, b, 2.0::DOUBLE * list_reduce(string_split(b, ''), lambda line, ch: list_transform(range(1, length(a) + 1), lambda i: greatest(list_max(line[1:i]), list_max(list_transform(range(1, i + 1), lambda k: CASE WHEN a[k] = ch THEN coalesce(line[k - 1], 0) + 1 ELSE 0 END)))), list_transform(range(1, length(a) + 1), lambda i: 0::BIGINT))[-1] / (length(a) + length(b)) AS ratio FROM (SELECT DISTINCT a, b FROM near)
), by_sku AS MATERIALIZED (
  SELECT named.row_idx AS catalog_idx, sold.row_idx AS offer_idx, round(ratio * boost, 4) AS confidence, 'SKU_BRAND' AS match_method FROM near JOIN alike USING (a, b) JOIN named ON named.sku = a AND named.brand IS NOT DISTINCT FROM a_brand JOIN sold ON sold.sku = b AND sold.brand IS NOT DISTINCT FROM b_brand WHERE round(ratio * boost, 4) >= 0.6
)"""


@query(f"{WITH}, {SKU_SQL} SELECT * FROM by_sku")
def sku_brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default threshold, at which brands in conflict never match."""
    return matching.sku_brand(*inputs(spark, sf_dir)).select("catalog_idx", "offer_idx", "confidence", "match_method")


@query(
    "WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 20 = 0) SELECT a AS left_key, vec_id AS right_key, round(list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]), 4) AS cosine FROM q, embeddings WHERE round(list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]), 4) >= 0.5"
)
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, ids divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    unit = vectors.select("vec_id", F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(x).alias("v"))
    close = matching.similar(unit.where("vec_id % 20 = 0").select(F.col("vec_id").alias("left_key"), F.col("v").alias("left_vec")), unit.select(F.col("vec_id").alias("right_key"), F.col("v").alias("right_vec")), 0.5)
    return close.select("left_key", "right_key", F.round("cosine", 4).alias("cosine"))


#: Words at the sum of their code points, as the stand-in encoder counts them, for a text t.
BAG = "[len([w for w in string_split(t, ' ') if list_sum([unicode(ch) for ch in string_split(w, '')]) % 64 = d])::DOUBLE for d in range(64)]"


@query(
    f"{WITH}, l AS (SELECT DISTINCT lower(concat_ws(' ', brand, title, category)) AS t FROM catalog), r AS (SELECT DISTINCT lower(concat_ws(' ', brand, title)) AS t FROM offers), "
    f"lv AS MATERIALIZED (SELECT t, {BAG} AS v FROM l), rv AS MATERIALIZED (SELECT t, {BAG} AS v FROM r) SELECT lv.t AS left_key, rv.t AS right_key, round(list_cosine_similarity(lv.v, rv.v), 4) AS cosine FROM lv, rv WHERE round(list_cosine_similarity(lv.v, rv.v), 4) >= 0.6"
)
def semantic_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products' texts against all offers' texts by the stand-in encoder, as distinct texts."""
    catalog, offers = inputs(spark, sf_dir)
    left = catalog.select(text.product_text(F.col("brand"), F.col("title"), F.col("category")).alias("left_key"))
    right = offers.select(text.product_text(F.col("brand"), F.col("title")).alias("right_key"))
    close = matching.similar(matching.encoded(left, "left_key", matching.bag_of_words, "left_vec"), matching.encoded(right, "right_key", matching.bag_of_words, "right_vec"), 0.6)
    return close.select("left_key", "right_key", F.round("cosine", 4).alias("cosine"))


BEST_SQL = f"WITH c AS ({plain(CANDIDATES)}), m AS (SELECT *, min(struct_pack(a := layer_ord, b := offer_idx)) OVER (PARTITION BY catalog_idx, source, source_id) AS met, row_number() OVER (PARTITION BY catalog_idx, source, source_id ORDER BY confidence DESC, layer_ord, offer_idx) AS n FROM c), d AS (SELECT * FROM m WHERE n = 1), j AS (SELECT *, confidence >= 0.6 AS ok, row_number() OVER (PARTITION BY catalog_idx, confidence >= 0.6 ORDER BY confidence DESC, met, offer_idx) AS r FROM d)"


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, CANDIDATES)
    offers = rows.select(F.col("offer_idx").alias("row_idx"), "source", "source_id")
    return matching.judged(matching.deduplicated(rows.drop("source", "source_id"), offers))


@query(f"{BEST_SQL} SELECT catalog_idx, offer_idx, confidence, layer_source, source, source_id FROM d")
def dedupe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied(spark, sf_dir).select("catalog_idx", "offer_idx", "confidence", "layer_source", "source", "source_id")


@query(f"{BEST_SQL} SELECT catalog_idx, offer_idx, confidence, CASE WHEN confidence > 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM j WHERE ok AND r = 1")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied(spark, sf_dir).where("status = 'accepted' and cand_rank = 1").select("catalog_idx", "offer_idx", "confidence", "confidence_level")


@query(f"{BEST_SQL} SELECT catalog_idx, count(*) FILTER (ok) AS accepted_count, count(*) FILTER (NOT ok) AS rejected_count FROM j GROUP BY catalog_idx")
def cascade_accept_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied(spark, sf_dir).groupBy("catalog_idx").agg(F.count_if(F.col("status") == "accepted").alias("accepted_count"), F.count_if(F.col("status") == "rejected").alias("rejected_count"))


@query(
    f"{BEST_SQL} SELECT catalog_idx, offer_idx, CASE layer_source WHEN 'exact_id' THEN 'gtin' WHEN 'sku_brand' THEN 'sku' ELSE 'snippet' END AS match_field, CASE layer_source WHEN 'exact_id' THEN 'PDP·GTIN' WHEN 'sku_brand' THEN CASE WHEN confidence >= 0.999 THEN 'PDP·SKU' ELSE 'PDP·SKU·norm' END ELSE CASE WHEN source = 'oxylabs' THEN 'title(oxy)' ELSE 'snippet' END END AS tier FROM j WHERE ok"
)
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tied(spark, sf_dir).where("status = 'accepted'")
    return rows.select("catalog_idx", "offer_idx", matching.match_field(F.col("layer_source")).alias("match_field"), matching.confidence_tier(F.col("layer_source"), F.col("confidence"), F.col("source")).alias("tier"))


VERDICTS = "SELECT catalog_idx, offer_idx, CASE WHEN offer_idx % 4 = 0 THEN false ELSE true END AS is_match, CASE WHEN offer_idx % 3 = 0 THEN -0.5::DOUBLE ELSE 0.05::DOUBLE END AS adjustment FROM j WHERE offer_idx % 5 < 3"


@query(
    f"{BEST_SQL}, v AS ({VERDICTS}), x AS (SELECT j.catalog_idx, j.offer_idx, ok, v.is_match, CASE WHEN ok AND v.is_match IS NOT NULL THEN round(least(greatest(confidence + least(greatest(adjustment, -0.3), 0.1), 0), 1), 4) ELSE confidence END AS c FROM j LEFT JOIN v USING (catalog_idx, offer_idx)) "
    "SELECT catalog_idx, offer_idx, c AS confidence, CASE WHEN ok AND coalesce(is_match, true) AND c >= 0.6 THEN 'accepted' ELSE 'rejected' END AS status FROM x"
)
def reviewer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tied(spark, sf_dir).withColumn("match_method", F.lit("SEMANTIC"))
    verdicts = rows.where("offer_idx % 5 < 3").select("catalog_idx", "offer_idx", (F.col("offer_idx") % 4 != 0).alias("is_match"), F.when(F.col("offer_idx") % 3 == 0, -0.5).otherwise(0.05).alias("adjustment"))
    return matching.reviewed(rows, verdicts).select("catalog_idx", "offer_idx", "confidence", "status")


def made_reviewer() -> models.Answer:
    """A reviewer that answers by the offer's number, which its title ends with: with a match or none, in words, or not at all."""

    def answer(prompt: str) -> str:
        n = int(re.search(r"title: T(\d+)$", prompt.split("Offer")[1], re.MULTILINE)[1])
        if n % 5 == 3:
            return "I cannot tell"
        if n % 5 == 4:
            raise TimeoutError("busy")
        return json.dumps({"is_match": n % 4 != 0, "confidence_adjustment": -0.5 if n % 3 == 0 else 0.05, "reason": f"as {n % 7}"})

    return answer


@query(
    f"{BEST_SQL}, x AS (SELECT *, ok AND offer_idx % 5 < 3 AS told, CASE WHEN ok AND offer_idx % 5 < 3 THEN round(least(greatest(confidence + CASE WHEN offer_idx % 3 = 0 THEN -0.3 ELSE 0.05 END, 0), 1), 4) ELSE confidence END AS c FROM j), y AS (SELECT *, ok AND (NOT told OR offer_idx % 4 <> 0 AND c >= 0.6) AS kept FROM x) "
    "SELECT catalog_idx, offer_idx, c AS confidence, CASE WHEN kept THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN kept THEN row_number() OVER (PARTITION BY catalog_idx, kept ORDER BY c DESC, r, offer_idx) END AS place, CASE WHEN c > 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, "
    "CASE WHEN told AND offer_idx % 4 <> 0 THEN 'AI_VERIFIED' ELSE 'SEMANTIC' END AS match_method, CASE WHEN ok AND NOT told THEN 'skipped' END AS ai_gate, CASE WHEN ok AND offer_idx % 5 = 4 THEN 'busy' WHEN ok AND offer_idx % 5 = 3 THEN 'unread' END AS ai_error, CASE WHEN told THEN concat('as ', offer_idx % 7) END AS ai_reason FROM y"
)
def model_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates asked of a model, one by one; some answers cannot be read, some never come."""
    rows = tied(spark, sf_dir).withColumn("match_method", F.lit("SEMANTIC"))
    empty = F.lit(None).cast("string")
    offers = derived(spark, sf_dir, CANDIDATES).select(F.col("offer_idx").alias("row_idx"), F.concat(F.lit("T"), "offer_idx").alias("title"), *(empty.alias(c) for c in ("brand", "sku", "ean", "price")))
    found = cascade.reviewed(rows, derived(spark, sf_dir, CATALOG), offers, models.Model(made_reviewer, tries=2, wait=0))
    error = F.when(F.col("review.ai_error") == "busy", "busy").when(F.col("review.ai_error").isNotNull(), "unread")
    place = F.when(F.col("status") == "accepted", F.col("cand_rank").cast("long"))
    return found.select("catalog_idx", "offer_idx", "confidence", "status", place.alias("place"), "confidence_level", "match_method", "review.ai_gate", error.alias("ai_error"), "review.ai_reason")


HIT_SQL = f"WITH h AS ({plain(HITS)}), u AS (SELECT *, concat('https://', regexp_extract(url, '^https://(www\\.)?([^/]*)', 2), '/p/', catalog_idx, '?color=', regexp_extract(url, 'color=([0-9])', 1)) AS u, regexp_extract(url, '^https://(www\\.)?([^/]*)', 2) AS domain, CASE WHEN price IS NULL THEN 0 ELSE 4 END + CASE WHEN shipping_cost IS NULL THEN 0 ELSE 2 END + CASE WHEN snippet IS NULL THEN 0 ELSE 1 END AS rich FROM h), p AS (SELECT *, min(hit_idx) OVER (PARTITION BY catalog_idx, u) AS place, row_number() OVER (PARTITION BY catalog_idx, u ORDER BY rich DESC, hit_idx) AS n FROM u), q AS (SELECT * FROM p WHERE n = 1)"


@query(f"{HIT_SQL} SELECT catalog_idx, hit_idx, place, u AS url FROM q")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_operators.one_per_url(derived(spark, sf_dir, HITS)).select("catalog_idx", "hit_idx", "place", offer_functions.url(F.col("url")).alias("url"))


@query(f"{HIT_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY catalog_idx, domain ORDER BY price NULLS LAST, rich DESC, place) AS k FROM q) SELECT catalog_idx, hit_idx, domain, price FROM d WHERE k = 1")
def domain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_operators.one_per_domain(offer_operators.one_per_url(derived(spark, sf_dir, HITS))).select("catalog_idx", "hit_idx", "domain", "price")


@query(f"WITH h AS ({plain(HITS)}), catalog AS ({plain(CATALOG)}) SELECT h.catalog_idx, hit_idx, CASE WHEN contains(lower(h.snippet), lower(c.sku)) THEN c.sku END AS sku, cast(NULL as string) AS ean, CASE WHEN contains(lower(concat_ws(' ', h.title, h.snippet, h.url)), lower(c.brand)) THEN c.brand END AS brand FROM h LEFT JOIN catalog c ON h.catalog_idx = c.row_idx")
def confirm_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_operators.confirmed(derived(spark, sf_dir, HITS), derived(spark, sf_dir, CATALOG)).select("catalog_idx", "hit_idx", "sku", "ean", "brand")


@query(f"WITH h AS ({plain(HITS)}) SELECT catalog_idx, concat('searxng-', substr(sha1(url), 1, 16)) AS source_id, price, regexp_extract(url, '^https://(www\\.)?([^/]*)', 2) AS seller, 'IT' AS market FROM h")
def hits_as_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_operators.as_offers(derived(spark, sf_dir, HITS).withColumn("place", F.col("hit_idx")), "IT").select("catalog_idx", "source_id", "price", "seller", "market")


#: Titles of a merchant's feed: with the words of brand and name apart or inside others, with the SKU alone or inside a word.
FEED_TITLE = "CASE cast(row_idx % 6 as int) WHEN 0 THEN concat('New ', coalesce(brand, ''), ' ', title, ' set') WHEN 1 THEN concat('x', coalesce(sku, 'y'), 'z') WHEN 2 THEN concat(title, 's ', coalesce(brand, 'any'), 'ware') WHEN 3 THEN lower(coalesce(sku, '')) WHEN 4 THEN concat('only ', title) ELSE seller END"


@query(
    f"{WITH}, feed AS (SELECT row_idx AS item_idx, {FEED_TITLE} AS title, ean FROM offers), t AS MATERIALIZED (SELECT DISTINCT title, lower(title) AS low FROM feed), p AS MATERIALIZED (SELECT row_idx, lower(sku) AS sku, string_split(lower(concat_ws(' ', brand, title)), ' ') AS tokens FROM catalog), "
    "m AS (SELECT p.row_idx, t.title FROM p JOIN t ON contains(t.low, p.sku) UNION SELECT p.row_idx, t.title FROM p JOIN t ON contains(t.low, p.tokens[1]) AND contains(t.low, p.tokens[2]) AND contains(t.low, p.tokens[-1]) WHERE len([x for x in p.tokens if NOT contains(t.low, x)]) = 0) "
    "SELECT c.row_idx AS catalog_idx, f.item_idx FROM catalog c JOIN feed f ON c.ean = f.ean UNION SELECT m.row_idx, f.item_idx FROM m JOIN feed f ON m.title = f.title"
)
def feed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = inputs(spark, sf_dir)
    return offer_operators.feed_matches(catalog, offers.select(F.col("row_idx").alias("item_idx"), F.expr(FEED_TITLE).alias("title"), "ean"))


FEED_SHOP = "concat('s', cast(row_idx % 48 as string), '.it')"


@query(
    f"{WITH}, feed AS (SELECT row_idx AS item_idx, {FEED_TITLE} AS title, ean, price, {FEED_SHOP} AS shop, CASE row_idx % 4 WHEN 0 THEN 4.9 WHEN 2 THEN 0 END::DECIMAL(18,4) AS shipping FROM offers WHERE {FEED_TITLE} <> ''), t AS MATERIALIZED (SELECT DISTINCT title, lower(title) AS low FROM feed), p AS MATERIALIZED (SELECT row_idx, lower(sku) AS sku, string_split(lower(concat_ws(' ', brand, title)), ' ') AS tokens FROM catalog), "
    "m AS (SELECT p.row_idx, t.title FROM p JOIN t ON contains(t.low, p.sku) UNION SELECT p.row_idx, t.title FROM p JOIN t ON contains(t.low, p.tokens[1]) AND contains(t.low, p.tokens[2]) AND contains(t.low, p.tokens[-1]) WHERE len([x for x in p.tokens if NOT contains(t.low, x)]) = 0), "
    "f AS (SELECT c.row_idx AS catalog_idx, f.item_idx FROM catalog c JOIN feed f ON c.ean = f.ean UNION SELECT m.row_idx, f.item_idx FROM m JOIN feed f ON m.title = f.title), "
    "k AS (SELECT f.catalog_idx, shop, price, shipping, row_number() OVER (PARTITION BY f.catalog_idx, shop ORDER BY price NULLS LAST) AS n FROM f JOIN feed USING (item_idx)) SELECT catalog_idx, shop AS seller, price, shipping AS shipping_cost, CASE WHEN shipping IS NOT NULL THEN 'feed' END AS shipping_source, 'GBP' AS currency FROM k WHERE n = 1"
)
def feed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers as a merchant's feed, written as XML and read back: one offer for each product and shop among the items that match and have a title."""
    catalog, offers = stored_inputs(spark, sf_dir)
    cost = F.when(F.col("row_idx") % 4 == 0, "<g:shipping><g:price>4.90 GBP</g:price></g:shipping>").when(F.col("row_idx") % 4 == 2, "<g:shipping_price>0.00 GBP</g:shipping_price>").otherwise("")
    told = lambda tag, c: F.coalesce(F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")), F.lit(""))
    item = F.concat(F.lit("<item>"), told("title", F.expr(FEED_TITLE)), told("link", F.concat(F.lit("https://www."), F.expr(FEED_SHOP), F.lit("/i/"), F.col("row_idx").cast("string"))), F.coalesce(F.concat(F.lit("<g:price>"), F.col("price").cast("string"), F.lit(" GBP</g:price>")), F.lit("<g:price>ask GBP</g:price>")), told("g:gtin", F.col("ean")), cost, F.lit("</item>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = lambda place, tags: spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(place).alias("place"), F.lit(tags).alias("value"))
    lines = frame(0, "<rss><channel>").unionByName(offers.select(F.pmod("row_idx", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("place"), item.alias("value"))).unionByName(frame(2, "</channel></rss>"))
    lines.repartitionById(parts, "part").sortWithinPartitions("part", "place").select("value").write.text(folder := new_folder(spark, "feed"), compression="gzip")
    found = providers.feed_hits(catalog, providers.merchant_feed(spark, folder), alone=True)
    return online.fetched_offers(catalog, [("feed", found)]).select("catalog_idx", "seller", "price", "shipping_cost", "shipping_source", "currency")


PRICES = "CASE cast(l_orderkey % 5 as int) WHEN 0 THEN concat('€ 1.', lpad(cast(l_partkey % 1000 as string), 3, '0'), ',', lpad(cast(l_suppkey % 100 as string), 2, '0')) WHEN 1 THEN concat(cast(l_partkey as string), '.', lpad(cast(l_suppkey % 100 as string), 2, '0'), ' EUR') WHEN 2 THEN concat('1,', lpad(cast(l_partkey % 1000 as string), 3, '0'), '.5') WHEN 3 THEN 'n/a' ELSE concat('-', cast(l_partkey as string), ',5') END"
CLEAN = "regexp_replace(t, '[^0-9.,-]', '', 'g')"


def priced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(PRICES).alias("t"))


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, {PRICES} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, try_cast(replace(replace({CLEAN}, '.', ''), ',', '.') AS decimal(18,4)) AS it_price, try_cast(replace({CLEAN}, ',', '') AS decimal(18,4)) AS uk_price FROM a")
def price_market_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", money.price(F.col("t"), F.lit("IT")).alias("it_price"), money.price(F.col("t"), F.lit("UK")).alias("uk_price"))


@query(
    f"WITH a AS (SELECT l_orderkey, l_linenumber, {PRICES} AS t FROM lineitem), b AS (SELECT *, {CLEAN} AS r FROM a) SELECT l_orderkey, l_linenumber, try_cast(CASE WHEN r LIKE '%.%' AND r LIKE '%,%' THEN CASE WHEN instr(reverse(r), ',') < instr(reverse(r), '.') THEN replace(replace(r, '.', ''), ',', '.') ELSE replace(r, ',', '') END "
    "WHEN r LIKE '%,%' THEN CASE WHEN instr(reverse(r), ',') <= 3 THEN replace(r, ',', '.') ELSE replace(r, ',', '') END WHEN r LIKE '%.%' AND instr(reverse(r), '.') = 4 THEN replace(r, '.', '') ELSE r END AS decimal(18,4)) AS price FROM b"
)
def price_loose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", money.loose_price(F.col("t")).alias("price"))


STOCK = "concat('Articolo ', cast(l_partkey as string), CASE cast(l_orderkey % 4 as int) WHEN 0 THEN concat(', ', cast(l_quantity as int), ' pezzi disponibili') WHEN 1 THEN concat(' quantità: ', cast(l_quantity as int)) WHEN 2 THEN concat(' ', cast(l_quantity as int), ' in stock, solo 7 rimasti') ELSE ' esaurito' END)"


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS k, cast(l_quantity as int) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN k < 2 OR k = 2 AND q = 7 THEN q END AS stock, CASE k WHEN 3 THEN 'OUT_OF_STOCK' WHEN 1 THEN 'UNKNOWN' ELSE 'IN_STOCK' END AS availability FROM a")
def stock_and_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(STOCK).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", offer_functions.stock_in_text(F.col("t")).alias("stock"), offer_functions.availability(F.col("t")).alias("availability"))


SHIP = "CASE cast(l_orderkey % 5 as int) WHEN 0 THEN 'Spedizione gratuita' WHEN 1 THEN 'Spedizione gratuita sopra 99 €' WHEN 2 THEN concat('Spedizione: ', cast(l_suppkey % 50 as string), ',90 € consegna: € 4,50') WHEN 3 THEN 'a 12 € in negozio' ELSE concat('Prezzo € 1.', lpad(cast(l_partkey % 1000 as string), 3, '0'), ',50') END"


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS k, l_suppkey % 50 AS s, l_partkey % 1000 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 0::decimal(18,4) WHEN 2 THEN least(s + 0.9, 4.5)::decimal(18,4) END AS shipping, CASE k WHEN 1 THEN 99::decimal(18,4) WHEN 2 THEN (s + 0.9)::decimal(18,4) WHEN 3 THEN 12::decimal(18,4) WHEN 4 THEN (1000 + p + 0.5)::decimal(18,4) END AS first_price FROM a"
)
def shipping_and_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(SHIP).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", money.shipping_in_text(F.col("t"), F.lit("IT")).alias("shipping"), money.snippet_price(F.col("t"), F.lit("IT")).alias("first_price"))


@query(f"{WITH}, {LANDED_SQL} SELECT row_idx, {DECIMAL('ex_cents')}::decimal(18,4) AS ex_vat, {DECIMAL('landed_cents')}::decimal(18,4) AS landed FROM landed")
def vat_and_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.priced(derived(spark, sf_dir, OFFERS)).select("row_idx", "ex_vat", "landed")


@query(
    f"{WITH}, {EXACT_SQL}, {LANDED_SQL}, r AS (SELECT e.catalog_idx, e.offer_idx, CASE WHEN conflict THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence, o.landed_cents AS l, o.ex_cents, o.url, row_number() OVER (PARTITION BY e.catalog_idx ORDER BY e.conflict, e.offer_idx) AS k FROM exact_ e JOIN landed o ON e.offer_idx = o.row_idx) "
    f"SELECT c.row_idx AS catalog_idx, c.sku AS product_sku, {DECIMAL('ex_cents')} AS competitor_price, {DECIMAL('l')} AS competitor_landed, r.confidence, regexp_extract(url, '^https://(www\\.)?([^/]*)', 2) AS competitor_domain, row_number() OVER (PARTITION BY c.row_idx ORDER BY l NULLS LAST, k) AS place FROM catalog c LEFT JOIN r ON c.row_idx = r.catalog_idx"
)
def landscape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return landscape.landscape_rows(catalog, exact_accepted(catalog, offers), offers).select("catalog_idx", "product_sku", "competitor_price", "competitor_landed", "confidence", "competitor_domain", F.col("place").cast("long").alias("place"))


@query(
    f"{WITH}, {EXACT_SQL}, b AS (SELECT catalog_idx, min(conflict::INT) AS x FROM exact_ GROUP BY 1), m AS (SELECT e.*, row_number() OVER (PARTITION BY catalog_idx ORDER BY conflict, offer_idx) AS k FROM exact_ e), f AS (SELECT * FROM m WHERE k = 1), t AS (SELECT (SELECT count(*) FROM catalog)::DOUBLE AS n, (SELECT count(*) FROM f)::DOUBLE AS m) "
    "SELECT 'total_products' AS metric, n AS value FROM t UNION ALL SELECT 'matched_products', m FROM t UNION ALL SELECT 'match_rate_pct', round(100 * m / n, 2) FROM t UNION ALL SELECT concat('level.', CASE WHEN conflict THEN 'MEDIUM' ELSE 'HIGH' END), count(*)::DOUBLE FROM f GROUP BY 1 UNION ALL SELECT concat('method.', match_method), count(*)::DOUBLE FROM f GROUP BY 1"
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return landscape.run_statistics(catalog, exact_accepted(catalog, offers))


@query(f"{WITH}, {EXACT_SQL} SELECT count(*) AS total_offers, round(count(*) / count(DISTINCT catalog_idx), 2) AS avg_offers_per_matched, count(shipping_cost) AS offers_with_shipping, 0::BIGINT AS offers_pdp_verified FROM exact_ JOIN offers ON offer_idx = row_idx")
def offer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return landscape.offer_statistics(exact_accepted(catalog, offers), offers)


@query(f"{WITH}, {EXACT_SQL} SELECT source AS provider, count(*) AS n_offers FROM exact_ JOIN offers ON offer_idx = row_idx GROUP BY 1")
def provider_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return landscape.by_provider(exact_accepted(catalog, offers), offers)


@query(f"{WITH}, {EXACT_SQL} SELECT catalog_idx, offer_idx FROM exact_ JOIN offers ON offer_idx = row_idx WHERE price IS NOT NULL AND shipping_cost IS NOT NULL")
def complete_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, offers = stored_inputs(spark, sf_dir)
    return cascade.with_complete_offers(cascade.Linked(exact_accepted(catalog, offers), catalog), offers).select("catalog_idx", "offer_idx")


CASCADE_SQL = (
    f"{WITH}, {EXACT_SQL}, {SKU_SQL}, sure AS (SELECT catalog_idx, offer_idx, CASE WHEN conflict THEN 0.7 ELSE 0.95 END::DOUBLE AS confidence, match_method, 0 AS layer FROM exact_ UNION ALL SELECT *, 1 FROM by_sku), open_ AS (SELECT row_idx, lower(concat_ws(' ', brand, title, category)) AS t FROM catalog WHERE row_idx NOT IN (SELECT catalog_idx FROM sure WHERE confidence >= 0.9)), "
    f"texts AS (SELECT row_idx, lower(concat_ws(' ', brand, title)) AS t FROM offers), lv AS MATERIALIZED (SELECT t, {BAG} AS v FROM (SELECT DISTINCT t FROM open_)), rv AS MATERIALIZED (SELECT t, {BAG} AS v FROM (SELECT DISTINCT t FROM texts)), meant AS (SELECT lv.t AS a, rv.t AS b, round(list_cosine_similarity(lv.v, rv.v), 4) AS confidence FROM lv, rv WHERE round(list_cosine_similarity(lv.v, rv.v), 4) >= 0.6), "
    "all_ AS (SELECT * FROM sure UNION ALL SELECT open_.row_idx, texts.row_idx, confidence, 'SEMANTIC', 2 FROM meant JOIN open_ ON open_.t = a JOIN texts ON texts.t = b), p AS (SELECT a.*, least(min(layer) OVER pair, CASE WHEN o.sku <> '' THEN 1 ELSE 2 END) AS met, row_number() OVER (pair ORDER BY confidence DESC, layer) AS n FROM all_ a JOIN offers o ON a.offer_idx = o.row_idx WINDOW pair AS (PARTITION BY catalog_idx, offer_idx)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY catalog_idx ORDER BY confidence DESC, met, offer_idx) AS place FROM p WHERE n = 1)"
)


@query(CASCADE_SQL + " SELECT catalog_idx, offer_idx, confidence, match_method, CASE WHEN confidence > 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM r WHERE place = 1")
def whole_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers; tests hold it against a comparison of all pairs and known answers as well."""
    catalog, offers = stored_inputs(spark, sf_dir)
    return cascade.link(catalog, offers).best.select("catalog_idx", "offer_idx", "confidence", "match_method", "confidence_level")


PAGE_GTIN = "CASE WHEN offer_idx % 3 = 0 THEN NULL WHEN offer_idx % 3 = 1 THEN concat('A', cast(catalog_idx as string)) ELSE concat('B', cast(offer_idx % 2 as string)) END"


@query(
    f"WITH c AS ({plain(CANDIDATES)}), v AS (SELECT catalog_idx, offer_idx, {PAGE_GTIN} AS page_gtin, row_number() OVER (PARTITION BY catalog_idx ORDER BY confidence DESC, offer_idx) AS place FROM c), n AS (SELECT catalog_idx, page_gtin, count(*) AS k, min(place) AS i FROM v WHERE page_gtin IS NOT NULL AND catalog_idx % 2 = 0 GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT *, row_number() OVER (PARTITION BY catalog_idx ORDER BY k DESC, i) AS r FROM n) "
    "SELECT v.catalog_idx, v.offer_idx, coalesce(v.page_gtin = b.page_gtin, false) AS gtin_recovered, coalesce(v.page_gtin <> b.page_gtin, false) AS gtin_conflict FROM v LEFT JOIN b ON v.catalog_idx = b.catalog_idx AND b.r = 1"
)
def gtin_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.expr("row_number() over (partition by catalog_idx order by confidence desc, offer_idx)")
    shown = derived(spark, sf_dir, CANDIDATES).select("catalog_idx", "offer_idx", F.expr(PAGE_GTIN).alias("page_gtin"), rank.alias("cand_rank"))
    catalog = derived(spark, sf_dir, CATALOG).select("row_idx", *(F.when(F.col("row_idx") % 2 == 1, F.col(c)).alias(c) for c in ("ean", "gtin")))
    return pages.gtin_consensus(shown, catalog).select("catalog_idx", "offer_idx", "gtin_recovered", "gtin_conflict")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(www\\.)?([^/?#]*)', 2)) AS domain FROM pages")
def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", offer_functions.domain(F.col("url")).alias("domain"))


def json_page(c: Column) -> Column:
    ld = F.format_string('{"@graph":[{"@type":"WebPage"},{"@type":["Product"],"sku":"%s","gtin13":"%s","name":"x","offers":{"price":"%s","priceCurrency":"EUR","availability":"https://schema.org/InStock","inventoryLevel":{"value":%d}}}]}', F.col("sku"), F.col("ean"), F.col("price").cast("string"), (c % 50).cast("int"))
    return F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script>"), F.rpad(F.lit("<p>"), 1200, "x"), F.lit("</p></html>"))


@query(f"WITH catalog AS ({plain(CATALOG)}) SELECT row_idx, sku AS page_sku, ean AS page_gtin, price AS page_price, 'EUR' AS page_currency, 'IN_STOCK' AS page_availability, cast(row_idx % 50 as int) AS page_stock FROM catalog")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived(spark, sf_dir, CATALOG).select(F.col("row_idx").cast("string").alias("url"), json_page(F.col("row_idx")).alias("html"), F.lit(200).alias("status_code"))
    return pages.read_pages(made).select(F.col("url").cast("long").alias("row_idx"), "page_sku", "page_gtin", "page_price", "page_currency", "page_availability", "page_stock")


@query(f"WITH offers AS ({plain(OFFERS)}) SELECT market, count(*) AS n FROM offers GROUP BY market ORDER BY n DESC, min(row_idx) LIMIT 1")
def market_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.votes(derived(spark, sf_dir, OFFERS).select("row_idx", "market"))


CONFIRMED = "CASE cast(offer_idx % 4 as int) WHEN 0 THEN NULL WHEN 1 THEN 'PDP·GTIN' WHEN 2 THEN 'PDP·SKU·norm' ELSE 'json_ld' END"


@query(f"WITH c AS ({plain(CANDIDATES)}) SELECT catalog_idx, offer_idx FROM c WHERE offer_idx % 9 <> 0 AND (layer_source <> 'semantic' OR starts_with(coalesce({CONFIRMED}, ''), 'PDP·'))")
def strict_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, CANDIDATES).withColumn("confirmation_method", F.expr(CONFIRMED)).withColumn("gtin_conflict", F.expr("CASE WHEN offer_idx % 9 = 0 THEN true WHEN offer_idx % 9 = 1 THEN false END"))
    return landscape.identity_confirmed(rows).select("catalog_idx", "offer_idx")


#: What the layers meet of a product: all offers, or, where one is sure, those with a SKU or an equal code.
MET_SQL = "met_ AS (SELECT c.row_idx AS catalog_idx, CASE WHEN c.row_idx IN (SELECT row_idx FROM open_) THEN (SELECT count(*) FROM offers) ELSE (SELECT count(*) FROM offers WHERE sku <> '') + coalesce(x.n, 0) END AS n_met FROM catalog c LEFT JOIN (SELECT e.catalog_idx, count(*) AS n FROM exact_ e JOIN offers o ON e.offer_idx = o.row_idx WHERE coalesce(o.sku, '') = '' GROUP BY 1) x ON x.catalog_idx = c.row_idx)"
#: The digits of a cosine's last places are an engine's own.
NO_COSINE = '("cosine":)[-0-9.E]+'


@query(
    f"{CASCADE_SQL}, {MET_SQL}, n AS (SELECT catalog_idx, count(*) AS n FROM r GROUP BY 1), b AS (SELECT r.*, e.identifier, e.conflict, k.ratio FROM r LEFT JOIN exact_ e USING (catalog_idx, offer_idx) JOIN offers o ON o.row_idx = r.offer_idx JOIN catalog c ON c.row_idx = r.catalog_idx LEFT JOIN alike k ON k.a = upper(c.sku) AND k.b = upper(o.sku) WHERE place = 1) "
    "SELECT c.row_idx AS catalog_idx, c.sku AS catalog_sku, c.ean AS catalog_ean, c.title AS catalog_title, c.brand AS catalog_brand, c.market AS catalog_market, coalesce(o.title, '') AS matched_competitor_title, coalesce(o.brand, '') AS matched_competitor_brand, "
    "CASE WHEN b.place IS NULL THEN '' ELSE coalesce(cast(o.price as varchar), 'None') END AS matched_price, coalesce(o.currency, '') AS matched_currency, coalesce(cast(o.shipping_cost as varchar), '') AS matched_shipping, coalesce(o.source, '') AS matched_source, coalesce(o.url, '') AS matched_url, "
    "coalesce(printf('%.4f', b.confidence), '') AS confidence, CASE WHEN b.place IS NULL THEN '' WHEN b.confidence > 0.9 THEN 'HIGH' WHEN b.confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, coalesce(b.match_method, '') AS match_method, "
    """CASE b.match_method WHEN 'SEMANTIC' THEN '{"cosine":}' WHEN 'SKU_BRAND' THEN concat('{"fuzzy_score":', b.ratio, ',"brand_state":"', CASE WHEN c.brand IS NULL OR o.brand IS NULL THEN 'unknown' WHEN lower(c.brand) = lower(o.brand) THEN 'match' ELSE 'conflict' END, '"}') """
    """WHEN 'EXACT_EAN' THEN concat('{"matched_on":"ean","identifier":"', b.identifier, '","brand_conflict":', b.conflict, '}') WHEN 'EXACT_GTIN' THEN concat('{"matched_on":"gtin","identifier":"', b.identifier, '","brand_conflict":', b.conflict, '}') ELSE '' END AS match_details, """
    "coalesce(n.n, 0) AS all_candidates_count, n_met - coalesce(n.n, 0) AS rejected_count FROM catalog c JOIN met_ ON met_.catalog_idx = c.row_idx LEFT JOIN n ON n.catalog_idx = c.row_idx LEFT JOIN b ON b.catalog_idx = c.row_idx LEFT JOIN offers o ON o.row_idx = b.offer_idx"
)
def best_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file of the whole cascade, with its counts of accepted and rejected offers."""
    catalog, offers = stored_inputs(spark, sf_dir)
    linked = cascade.link(catalog, offers)
    linked = replace(linked, candidates=stored(linked.candidates))
    return landscape.best_rows(catalog, linked.accepted, offers, linked.rejected(catalog, offers)).withColumn("match_details", F.regexp_replace("match_details", NO_COSINE, "$1"))


@query(f"WITH h AS ({plain(HITS)}) SELECT hit_idx AS catalog_idx, title, url, price, CASE WHEN price IS NOT NULL THEN 'EUR' END AS currency FROM h")
def web_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit put into a result page with its redirect, and an advertisement of the engine."""
    body = F.concat(
        F.lit('<html><body><div class="result x"><a class="result__a" href="https://duckduckgo.com/y.js?ad=1">ad</a></div><div class="result"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">'), F.col("title"),
        F.lit('</a></h2><a class="result__snippet">'), F.coalesce(F.concat(F.lit("solo "), F.col("price").cast("int").cast("string"), F.lit(" &euro;")), F.lit("ask<br>us")), F.lit("</a></div>")
    )
    made = derived(spark, sf_dir, HITS).select(F.col("hit_idx").alias("catalog_idx"), body.alias("body"))
    return result_pages.duckduckgo(made).select("catalog_idx", "title", "url", "price", "currency")


@query(f"WITH h AS ({plain(HITS)}) SELECT hit_idx AS catalog_idx, title, concat('https://www.example.it/go/', cast(hit_idx as varchar)) AS url, price + 0.5 AS price, CASE hit_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 4.99 END::decimal(18,4) AS shipping_cost FROM h WHERE price IS NOT NULL")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit put into a listing's row, after one without a price; no row has its end tag, and those without a price give no offer."""
    price = F.coalesce(F.concat(F.lit('<b class="item_price">'), F.col("price").cast("int").cast("string"), F.lit(",50 &euro;</b>")), F.lit(""))
    shipping = F.when(F.col("hit_idx") % 3 == 0, '<i class="item_delivery">Spedizione Gratis</i>').when(F.col("hit_idx") % 3 == 1, '<i class="item_delivery">4,99 &euro;</i>').otherwise("")
    body = F.concat(F.lit('<ul><li class="item"><a href="/go/0">unpriced</a><p>more<li class="item"><a href="/go/'), F.col("hit_idx").cast("string"), F.lit('">'), F.col("title"), F.lit("</a>"), price, shipping, F.lit("</ul>"))
    made = derived(spark, sf_dir, HITS).select(F.col("hit_idx").alias("catalog_idx"), body.alias("body"), F.lit("https://www.example.it/list").alias("url"))
    return result_pages.trovaprezzi(made).select("catalog_idx", "title", "url", "price", "shipping_cost")


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", result_pages.visible_text("html").alias("text"))


#: Which provider a hit comes from; the costly one is given first.
SOURCE = "CASE cast(hit_idx % 3 as int) WHEN 0 THEN 'searxng' WHEN 1 THEN 'feed' ELSE 'keepa' END"


@query(
    f"WITH h AS (SELECT * REPLACE ({SOURCE} AS source_provider), CASE hit_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier FROM ({plain(HITS)})), u AS (SELECT *, concat('https://', regexp_extract(url, '^https://(www\\.)?([^/]*)', 2), '/p/', catalog_idx, '?color=', regexp_extract(url, 'color=([0-9])', 1)) AS u, regexp_extract(url, '^https://(www\\.)?([^/]*)', 2) AS domain, "
    "CASE WHEN price IS NULL THEN 0 ELSE 4 END + CASE WHEN shipping_cost IS NULL THEN 0 ELSE 2 END + CASE WHEN snippet IS NULL THEN 0 ELSE 3 END AS rich FROM h), p AS (SELECT *, min(struct_pack(a := tier, b := hit_idx)) OVER (PARTITION BY catalog_idx, u) AS place, row_number() OVER (PARTITION BY catalog_idx, u ORDER BY rich DESC, tier, hit_idx) AS n FROM u), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY catalog_idx, domain ORDER BY price NULLS LAST, rich DESC, place) AS k FROM p WHERE n = 1) "
    "SELECT catalog_idx, source_provider AS source, concat(source_provider, '-', substr(sha1(url), 1, 16)) AS source_id, price, shipping_cost, CASE WHEN shipping_cost IS NULL THEN NULL WHEN source_provider = 'feed' THEN 'feed' WHEN source_provider = 'keepa' THEN 'api' END AS shipping_source, domain AS seller FROM d WHERE k = 1"
)
def provider_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three providers to one offer for each product and shop."""
    hits = derived(spark, sf_dir, HITS).withColumn("source_provider", F.expr(SOURCE))
    found = [(name, hits.where(F.col("source_provider") == name)) for name in ("keepa", "searxng", "feed")]
    return online.fetched_offers(derived(spark, sf_dir, CATALOG), found).select("catalog_idx", "source", "source_id", "price", "shipping_cost", "shipping_source", "seller")


@query(f"{BEST_SQL}, x AS (SELECT *, ok AND offer_idx % 9 <> 0 AND (layer_source <> 'semantic' OR starts_with(coalesce({CONFIRMED}, ''), 'PDP·')) AS sure FROM j) SELECT catalog_idx, offer_idx, CASE WHEN sure THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN sure THEN row_number() OVER (PARTITION BY catalog_idx, sure ORDER BY confidence DESC, r, offer_idx) END AS place FROM x")
def strict_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict matching rejects, and the others' new ranks."""
    rows = tied(spark, sf_dir).withColumn("confirmation_method", F.expr(CONFIRMED)).withColumn("gtin_conflict", F.expr("offer_idx % 9 = 0"))
    return landscape.strict(rows).select("catalog_idx", "offer_idx", "status", F.when(F.col("status") == "accepted", F.col("cand_rank").cast("long")).alias("place"))


def made_answers() -> fetching.Fetch:
    """A client that answers by the query's length: so many pages, and for some a failure at the second."""

    def fetch(asked: str, market: str, page: int) -> str | None:
        if page == 2 and len(asked) % 5 == 0:
            raise fetching.Unavailable("blocked")
        return f'{{"results":[{{"title":"{market}","url":"https://s.it/{page}"}}]}}' if page <= len(asked) % 4 else None

    return fetch


@query(
    f"WITH catalog AS ({plain(CATALOG)}), a AS (SELECT row_idx, [concat(brand, ' \"', sku, '\"'), concat('\"', ean, '\"'), concat(brand, ' ', title)] AS asked FROM catalog), q AS (SELECT row_idx, n, asked[n + 1] AS query FROM a, range(3) AS t(n)), p AS (SELECT *, length(query) AS k FROM q, range(1, 4) AS t(page)) "
    "SELECT row_idx AS catalog_idx, provider, n::INT AS query_no, query, page::INT AS page, CASE WHEN provider = 'searxng' AND page = 2 AND k % 5 = 0 THEN 'blocked' END AS reason FROM p, (VALUES ('searxng'), ('serper')) AS v(provider) WHERE page <= CASE provider WHEN 'serper' THEN 1 ELSE 3 END AND (page <= k % 4 OR page = 2 AND k % 5 = 0 AND k % 4 = 1) AND NOT (page > 2 AND k % 5 = 0)"
)
def provider_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's queries asked of two providers, page by page until an empty one or a failure; a third is not available."""
    asked = [fetching.Provider("serper", made_answers), fetching.Provider("keepa", made_answers, lambda: False), fetching.Provider("searxng", made_answers, most_pages=3)]
    return fetching.fetched(fetching.queries_of(derived(spark, sf_dir, CATALOG)), asked).drop("body")


def made_site() -> page_fetching.Get:
    """A site that by an address's length gives no answer, none of that name, a nearly empty page, or one."""

    def get(url: str, market: str) -> tuple[int, str]:
        if len(url) % 7 == 0:
            raise fetching.Unavailable("blocked")
        return (404, "gone") if len(url) % 5 == 0 else (200, "thin") if len(url) % 3 == 0 else (200, url.ljust(1200))

    return get


def made_browser() -> page_fetching.Get:
    def get(url: str, market: str) -> tuple[int, str]:
        if len(url) % 11 == 0:
            raise fetching.Unavailable("blocked")
        return (200, url.ljust(2000)) if len(url) % 2 == 0 else (403, "")

    return get


@query(
    f"{WITH}, u AS (SELECT DISTINCT url, length(url) AS k FROM offers), p AS (SELECT *, k % 7 <> 0 AND k % 5 <> 0 AND k % 3 <> 0 AS plain FROM u) "
    "SELECT url, CASE WHEN plain THEN 200 WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN 200 ELSE 403 END::INT AS status_code, CASE WHEN plain THEN 'plain' ELSE 'browser' END AS fetched_by, plain OR (k % 11 <> 0 AND k % 2 = 0) AS ok, CASE WHEN NOT plain AND k % 11 = 0 THEN 'Unavailable: blocked' END AS reason, "
    "CASE WHEN plain THEN 1200 WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN 2000 ELSE 0 END::INT AS n_chars FROM p"
)
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each offer's address by made sites, without a pace: plainly, and where that gives nothing usable by a browser."""
    ways = [page_fetching.Tier("plain", made_site), page_fetching.Tier("browser", made_browser)]
    found = page_fetching.fetched(derived(spark, sf_dir, OFFERS).select("url"), ways, pace=page_fetching.Pace(0))
    return found.select("url", "status_code", "fetched_by", "ok", "reason", F.length("html").alias("n_chars"))


#: The kind of page that an offer has: none, structured data, meta tags, nearly empty, structured data of another shop's product, no address, the SKU alone,
#: structured data nested too deep to read.
PAGE_KIND = "CASE WHEN row_idx % 97 = 7 THEN 7 ELSE cast(row_idx % 7 as int) END"
PAGE_URL = f"CASE {PAGE_KIND} WHEN 5 THEN '' WHEN 6 THEN concat('https://www.sovatem.it/', cast(row_idx as string)) ELSE concat('https://s.it/', cast(row_idx as string)) END"


def made_pages(offers: DataFrame) -> DataFrame:
    ld = lambda sku, code, money_: F.format_string('<script type="application/ld+json">{"@type":"Product","sku":"%s","gtin13":"%s","offers":[{"price":"%s","priceCurrency":"%s","availability":"https://schema.org/OutOfStock","inventoryLevel":%d,"seller":{"name":"Shop"}}]}</script>', sku, code, F.lit("12.50"), F.lit(money_), (F.col("row_idx") % 50).cast("int"))
    kind = F.expr(PAGE_KIND)
    body = (
        F.when(kind == 1, ld(F.col("p_sku"), F.col("p_ean"), "EUR"))
        .when(kind == 2, F.concat(F.lit('<meta property="og:price:amount" content="9,90"><meta content="eur" property="og:price:currency">code '), F.col("p_ean"), F.lit(". Spedizione gratuita")))
        .when(kind == 4, ld(F.lit("none"), F.lit("4006381333931"), "USD"))
        .when(kind == 6, F.concat(F.lit("article "), F.lower("p_sku")))
        .when(kind == 7, F.concat(F.col("p_ean"), F.lit('<script type="application/ld+json">'), F.repeat(F.lit("["), F.lit(12_000)), F.lit("</script>")))
        .otherwise("")
    )
    page = F.concat(F.lit("<html><body>"), body, F.when(kind == 3, "").otherwise(F.rpad(F.lit("<p>"), 1200, "x")), F.lit("</p></body></html>"))
    return offers.where(kind.isin(1, 2, 3, 4, 6, 7)).select("url", page.alias("html"), F.lit(200).alias("status_code"))


VERIFIED_SQL = f"""{WITH}, {EXACT_SQL}, k AS (
  SELECT e.catalog_idx, e.offer_idx, e.conflict, {PAGE_KIND.replace('row_idx', 'o.row_idx')} AS kind, c.row_idx % 2 AS odd, o.price, o.shipping_cost, o.seller, o.vat_included, o.source, row_number() OVER (PARTITION BY e.catalog_idx ORDER BY e.conflict, e.offer_idx) AS cand_rank FROM exact_ e JOIN catalog c ON e.catalog_idx = c.row_idx JOIN offers o ON e.offer_idx = o.row_idx
), v AS (
  SELECT *, CASE WHEN kind IN (1, 2) THEN CASE WHEN odd = 0 THEN 'PDP·GTIN' ELSE 'PDP·EAN' END WHEN kind = 4 THEN 'json_ld' WHEN kind = 6 THEN 'PDP·SKU' END AS label FROM k
), f AS (
  SELECT catalog_idx, offer_idx, label AS confirmation_method, label IS NOT NULL AS pdp_verified, CASE WHEN kind = 5 THEN 'no_url' WHEN kind IN (0, 3) THEN 'fetch_failed' WHEN kind = 7 THEN 'error' END AS pdp_skip_reason, CASE kind WHEN 1 THEN 'json_ld' WHEN 4 THEN 'json_ld' WHEN 2 THEN 'meta' WHEN 6 THEN 'regex' END AS extraction_method,
         CASE kind WHEN 1 THEN 12.5::DECIMAL(18,4) WHEN 2 THEN 9.9::DECIMAL(18,4) ELSE price END AS price, CASE WHEN kind IN (2, 6) THEN 0::DECIMAL(18,4) ELSE shipping_cost END AS shipping_cost, CASE kind WHEN 2 THEN 'page' WHEN 6 THEN 'rule' END AS shipping_source,
         CASE WHEN kind IN (1, 4) THEN 'OUT_OF_STOCK' ELSE 'IN_STOCK' END AS availability, CASE WHEN kind IN (1, 4) THEN cast(offer_idx % 50 AS INT) END AS stock_quantity, CASE WHEN kind IN (1, 4) THEN 'Shop' ELSE seller END AS seller, cand_rank, source FROM v
)"""


def verified_offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact candidates with their pages' facts; products of odd numbers have no GTIN of their own."""
    catalog, offers = stored_inputs(spark, sf_dir)
    offers = offers.withColumn("url", F.expr(PAGE_URL))
    accepted = exact_accepted(catalog, offers).drop("source", "source_id")
    coded = accepted.select(F.col("offer_idx").alias("row_idx"), "catalog_idx").join(catalog.select(F.col("row_idx").alias("catalog_idx"), F.col("sku").alias("p_sku"), F.col("ean").alias("p_ean")), "catalog_idx")
    pages_ = made_pages(offers.join(coded.drop("catalog_idx"), "row_idx"))
    catalog = catalog.withColumn("gtin", F.when(F.col("row_idx") % 2 == 0, F.col("gtin")))
    return catalog, offers, pages.verify(accepted, catalog, offers, pages_)


@query(f"{VERIFIED_SQL} SELECT * EXCLUDE (cand_rank, source) FROM f")
def page_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ("confirmation_method", "pdp_verified", "pdp_skip_reason", "extraction_method", "price", "shipping_cost", "shipping_source", "availability", "stock_quantity", "seller")
    return verified_offers(spark, sf_dir)[2].select("catalog_idx", "offer_idx", *facts)


def made_extractor() -> models.Answer:
    """An extractor that reads a page's words for the product's title; it fails where they name no price, or another's."""

    def answer(prompt: str) -> str:
        asked, shown = (re.search(p, prompt)[1] for p in (r"title: (\S+)", r"about (\S+)"))
        if asked != shown:
            raise ValueError("another product")
        price = re.search(r"asks (\d+)", prompt)
        return json.dumps({"price": int(price[1]) + 0.5 if price else None, "currency": "eur", "shipping_cost": "4,90", "availability": "esaurito", "seller": "Worded"})

    return answer


@query(
    f"WITH c AS ({plain(CANDIDATES)}), s AS (SELECT *, offer_idx % 4 AS k FROM c), t AS (SELECT *, confidence < 0.75 AND k = 0 AS ai FROM s) "
    "SELECT catalog_idx, offer_idx, CASE WHEN ai THEN 'ai' END AS confirmation_method, ai AS pdp_verified, CASE WHEN k = 3 THEN 'fetch_failed' END AS pdp_skip_reason, CASE WHEN ai THEN 'ai' WHEN k = 2 THEN 'meta' END AS extraction_method, CASE WHEN ai THEN offer_idx % 90 + 0.5 WHEN k = 2 THEN 9.9 ELSE 1 END::DECIMAL(18,4) AS price, "
    "CASE WHEN ai THEN 4.9 END::DECIMAL(18,4) AS shipping_cost, CASE WHEN ai THEN 'OUT_OF_STOCK' ELSE 'UNKNOWN' END AS availability, CASE WHEN ai THEN 'Worded' END AS seller FROM t"
)
def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' pages, of which those without identifiers and prices are read by a model: of four kinds, a page states
    a price in words, none, one in a meta tag, or is missing."""
    rows = derived(spark, sf_dir, CANDIDATES)
    url = F.concat(F.lit("https://a.it/"), F.col("offer_idx").cast("string"))
    kind, text = F.col("offer_idx") % 4, F.concat(F.lit("<script>var asks = 1</script><p>about T"), F.col("catalog_idx").cast("string"), F.lit("</p>"))
    body = F.concat(text, F.when(kind == 0, F.concat(F.lit("<b>asks "), (F.col("offer_idx") % 90).cast("string"), F.lit("</b>"))).when(kind == 2, '<meta property="og:price:amount" content="9.90">').otherwise(""), F.rpad(F.lit("<p>"), 1100, "x"))
    shown = rows.where(kind < 3).select(url.alias("url"), body.alias("html"), F.lit(200).alias("status_code"))
    offers = online.of_offers(rows.select(F.col("offer_idx").alias("row_idx"), url.alias("url"), F.lit(1).alias("price"), F.lit("EUR").alias("currency"), F.lit("UNKNOWN").alias("availability")))
    catalog = rows.groupBy(F.col("catalog_idx").alias("row_idx")).agg(F.concat(F.lit("T"), F.first("catalog_idx")).alias("title")).select("*", *(F.lit(None).cast("string").alias(c) for c in ("brand", "sku", "ean", "gtin")))
    facts = ("confirmation_method", "pdp_verified", "pdp_skip_reason", "extraction_method", "price", "shipping_cost", "availability", "seller")
    return pages.verify(rows.select("catalog_idx", "offer_idx", "confidence"), catalog, offers, shown, extractor=models.Model(made_extractor, tries=1)).select("catalog_idx", "offer_idx", *facts)


@query(
    f"{VERIFIED_SQL} SELECT c.row_idx AS catalog_idx, f.offer_idx, coalesce(f.seller, f.source) AS competitor_name, f.confirmation_method AS label, CASE WHEN f.pdp_verified THEN 'yes' WHEN NOT f.pdp_verified THEN 'no' ELSE '' END AS pdp_verified, coalesce(f.extraction_method, '') AS extraction_method, "
    "CASE availability WHEN 'IN_STOCK' THEN 'yes' WHEN 'OUT_OF_STOCK' THEN 'no' END AS in_stock, CASE WHEN f.offer_idx IS NULL THEN '' WHEN f.shipping_cost IS NULL THEN 'unknown' WHEN f.shipping_cost = 0 THEN 'free' ELSE '' END AS shipping_note, f.stock_quantity AS competitor_stock_qty FROM catalog c LEFT JOIN f ON c.row_idx = f.catalog_idx"
)
def landscape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landscape's rows with their pages' labels; without one they bear the layers' tier, shown here as null."""
    catalog, offers, verified = verified_offers(spark, sf_dir)
    shown = online.with_page_facts(online.of_offers(offers), verified)
    rows = landscape.landscape_rows(catalog, verified.drop("url", *pages.OFFER_FACTS), shown)
    label = F.when((F.col("confirmation_method") != "PDP·GTIN") | (F.col("pdp_verified") == "yes"), F.col("confirmation_method"))
    return rows.select("catalog_idx", "offer_idx", "competitor_name", label.alias("label"), "pdp_verified", "extraction_method", "in_stock", "shipping_note", "competitor_stock_qty")


@query(f"{WITH} SELECT row_idx, concat(upper(brand), '/', CASE WHEN row_idx % 2 = 0 THEN concat(brand, ' ', title) ELSE concat(brand, 'x ', title) END) AS asked, CASE WHEN row_idx % 2 = 0 THEN concat(brand, ' ', title) ELSE concat_ws(' ', brand, concat(brand, 'x ', title)) END AS query, upper(regexp_replace(concat(' ', sku, chr(9), 'x '), '\\s', '', 'g')) AS sku FROM catalog")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of a provider for each product, and SKUs without white space."""
    title = F.when(F.col("row_idx") % 2 == 0, F.concat_ws(" ", "brand", "title")).otherwise(F.concat(F.col("brand"), F.lit("x "), F.col("title")))
    rows = derived(spark, sf_dir, CATALOG).withColumn("t", title)
    return rows.select("row_idx", F.concat_ws("/", F.upper("brand"), "t").alias("asked"), text.search_query(F.col("brand"), F.col("t")).alias("query"), identifiers.sku(F.concat(F.lit(" "), F.col("sku"), F.lit("\tx "))).alias("sku"))
