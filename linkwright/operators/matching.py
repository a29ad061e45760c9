"""The cascade that links offers to products: exact identifiers, SKU and brand, meaning.

``catalog`` has row_idx, sku, brand, title, category, ean, gtin; ``offers`` has row_idx, source,
source_id, title, brand, sku, ean, gtin. Each layer returns candidates: catalog_idx, offer_idx,
confidence, match_method, layer_source, layer_ord, details. Ties are broken by layer and offer_idx throughout,
since rows have no order of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, text
from .cosine import Block
from .metric import similar_within_brands
from .ordering import placed
from .shared import Spool
from .similarity import indel_ratio

#: Confidence of an exact match, and under a conflict of brands; SKU score by state of the brands.
EXACT, EXACT_CONFLICT = 0.95, 0.70
SAME, UNKNOWN, CONFLICT = 1.0, 0.7, 0.3
#: A product, or a pair, this sure needs no comparison of meaning.
CONFIDENT = 0.90
#: From this similarity on, SKUs of one brand are found by what they share instead of being compared with all.
CLOSE = 0.80
LAYERS = ("exact_id", "sku_brand", "semantic")
DETAILS = "struct<matched_on:string,identifier:string,brand_conflict:boolean,fuzzy_score:double,brand_state:string,cosine:double>"


def candidate(layer: str, confidence: Column, method: Column, **details: Column) -> list[Column]:
    names = [f.split(":") for f in DETAILS[len("struct<") : -1].split(",")]
    parts = [details.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in names]
    return [F.col("catalog_idx"), F.col("offer_idx"), confidence.alias("confidence"), method.alias("match_method"), F.lit(layer).alias("layer_source"), F.lit(LAYERS.index(layer)).alias("layer_ord"), F.struct(*parts).alias("details")]


def exact_id(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    """Equal EAN, else equal GTIN; one candidate a pair. Two known, different brands are a conflict.

    Both keys of a row are exploded to (kind, value), so one equi-join serves both; a value that
    very many offers share is split by adaptive execution.
    """

    def keyed(df: DataFrame, idx: str, brand: str) -> DataFrame:
        keys = F.array(F.struct(F.lit("ean").alias("kind"), identifiers.ean(F.col("ean")).alias("value")), F.struct(F.lit("gtin").alias("kind"), identifiers.gtin(F.col("gtin")).alias("value")))
        rows = df.select(F.col("row_idx").alias(idx), text.brand(F.col("brand")).alias(brand), F.filter(keys, lambda k: k["value"].isNotNull()).alias("keys"))
        return rows.select(idx, brand, F.inline("keys"))

    pairs = keyed(catalog, "catalog_idx", "brand_").join(keyed(offers, "offer_idx", "offer_brand"), ["kind", "value"])
    best = pairs.groupBy("catalog_idx", "offer_idx").agg(F.min(F.struct("kind", "value")).alias("key"), F.bool_or(F.coalesce(F.col("brand_") != F.col("offer_brand"), F.lit(False))).alias("conflict"))
    return best.select(
        *candidate("exact_id", F.when(F.col("conflict"), EXACT_CONFLICT).otherwise(EXACT), F.concat(F.lit("EXACT_"), F.upper("key.kind")), matched_on=F.col("key.kind"), identifier=F.col("key.value"), brand_conflict=F.col("conflict"))
    )


def spare(la: Column, lb: Column, least: float) -> Column:
    """How many characters at most only one of two strings of these lengths has, if they are as similar as ``least``."""
    most = F.floor((la + lb) * (1 - least) + 1e-9).cast("int")
    return most - F.pmod(la + lb - most, F.lit(2))  # 2 LCS = la + lb - spare is even


def with_lengths(df: DataFrame, sku: str, own: str, other: str, least: float) -> DataFrame:
    """df with the string's length, and a row for each length that a similar one can have."""
    n = F.length(sku)
    reach = F.sequence(F.floor(n * least / (2 - least)).cast("int"), F.ceil(n * (2 - least) / least).cast("int"))
    rows = df.withColumn(own, n).withColumn(other, F.explode(reach))
    return rows.where(F.abs(F.col(own) - F.col(other)) <= spare(F.col(own), F.col(other), least))


def cut(value: Column) -> Column:
    """What is left of a string without one of its characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.concat(F.substr(value, F.lit(1), i - 1), F.substr(value, i + 1))))


def shortened(value: Column, cuts: Column) -> Column:
    """The distinct strings that are left after none, one or two cuts."""
    twice = F.array_distinct(F.flatten(F.transform(cut(value), cut)))
    return F.when(cuts == 0, F.array(value)).when(cuts == 1, cut(value)).otherwise(twice)


def pieces(value: Column, n: Column, m: Column, before: Column, after: Column, length: Column) -> Column:
    """The m equal pieces of a string of n characters, as they may stand in a string of ``length``, moved by
    up to ``before`` to the left and ``after`` to the right: array of (piece number, text)."""

    def moved(i: Column) -> Column:
        begin, end = F.floor(i * n / m).cast("int"), F.floor((i + 1) * n / m).cast("int")
        starts = F.filter(F.transform(F.sequence(-before, after), lambda d: begin + d), lambda s: (s >= 0) & (s + end - begin <= length))
        return F.transform(starts, lambda s: F.struct(i.alias("piece"), F.substr(value, s + 1, end - begin).alias("part")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), m - 1), moved)))


def similar_skus(a: DataFrame, b: DataFrame, least: float, brands: list[str]) -> DataFrame:
    """The distinct pairs of rows of a (brand_, sku_) and b (offer_brand, offer_sku, and ``brands``, which must
    be equal) whose SKUs can be as similar as ``least``; by equi-joins alone, without loss.

    Two strings of given lengths that are so similar share a subsequence, which is either of them
    after so many cuts. Where that is at most two cuts of each, an equi-join on what is left finds
    them. Otherwise the first is parted in one piece more than characters may differ, so one piece
    stands unchanged in the second, and an equi-join on pieces finds them.
    """
    la, lb = F.col("la"), F.col("lb")
    most = spare(la, lb, least)
    from_a, from_b = ((most + la - lb) / 2).cast("int"), ((most + lb - la) / 2).cast("int")
    few = F.greatest(from_a, from_b) <= 2
    left, right = with_lengths(a, "sku_", "la", "lb", least), with_lengths(b, "offer_sku", "lb", "la", least)
    names = ["brand_", "sku_", "offer_brand", "offer_sku"]
    rest = [c for c in names if c not in brands]
    keys = [*brands, "la", "lb"]
    sides = lambda x, y, k: x.join(y, [*keys, *k]).select(*brands, *rest)
    by_cuts = sides(left.where(few).withColumn("form", F.explode(shortened(F.col("sku_"), from_a))), right.where(few).withColumn("form", F.explode(shortened(F.col("offer_sku"), from_b))), ["form"])
    zero = F.lit(0)
    own = left.where(~few).select("*", F.inline(pieces(F.col("sku_"), la, most + 1, zero, zero, la)))
    other = right.where(~few).select("*", F.inline(pieces(F.col("offer_sku"), la, most + 1, from_a, from_b, lb)))
    return by_cuts.unionByName(sides(own, other, ["piece", "part"])).distinct()


def sku_brand(catalog: DataFrame, offers: DataFrame, min_confidence: float = 0.60) -> DataFrame:
    """SKU similarity times what the brands say, where it can reach min_confidence or CONFIDENT.

    A conflict scores 0.3 at most and a missing brand 0.7, so above those thresholds such pairs are not
    made, and below them their SKUs must be the more similar. Pairs of one brand that need little
    similarity are found in a partition of the brand's SKUs by their distances to pivots, any others
    by equi-joins on what similar SKUs share. Distinct (brand, SKU) are compared, not rows: repeated
    offers cost nothing.
    """
    least = min(min_confidence, CONFIDENT)
    left = catalog.select(F.col("row_idx").alias("catalog_idx"), text.brand(F.col("brand")).alias("brand_"), identifiers.sku(F.col("sku")).alias("sku_")).where("sku_ <> ''")
    right = offers.select(F.col("row_idx").alias("offer_idx"), text.brand(F.col("brand")).alias("offer_brand"), identifiers.sku(F.col("sku")).alias("offer_sku")).where("offer_sku <> ''")
    a, b = left.select("brand_", "sku_").distinct(), right.select("offer_brand", "offer_sku").distinct()
    names = ["brand_", "sku_", "offer_brand", "offer_sku"]

    def scored(pairs: DataFrame, boost: float, state: str) -> DataFrame:
        ratio = F.col("ratio") if "ratio" in pairs.columns else indel_ratio("sku_", "offer_sku").alias("ratio")
        rows = pairs.select(*names, ratio)
        return rows.select("*", F.round(F.col("ratio") * boost, 4).alias("score"), F.lit(state).alias("state")).where(F.col("score") >= least)

    branded = b.where("offer_brand is not null").withColumn("brand_", F.col("offer_brand"))
    need = least - 0.00005
    if need >= CLOSE:
        alike = similar_skus(a, branded, need, ["brand_"])
    else:
        alike = similar_within_brands(a.where("brand_ is not null"), branded.select("brand_", "offer_sku"), need).withColumn("offer_brand", F.col("brand_"))
    out = scored(alike, SAME, "match")
    if need <= UNKNOWN:
        known = F.col("brand_").isNotNull()
        pairs = similar_skus(a.where(~known), b, need / UNKNOWN, []).unionByName(similar_skus(a.where(known), b.where("offer_brand is null"), need / UNKNOWN, []))
        out = out.unionByName(scored(pairs, UNKNOWN, "unknown"))
    if need <= CONFLICT:
        out = out.unionByName(scored(similar_skus(a, b, need / CONFLICT, []).where("brand_ <> offer_brand"), CONFLICT, "conflict"))
    found = out.join(left.withColumnRenamed("sku_", "sku_a").withColumnRenamed("brand_", "brand_a"), (F.col("sku_a") == F.col("sku_")) & F.col("brand_a").eqNullSafe(F.col("brand_")))
    found = found.join(right.withColumnRenamed("offer_sku", "sku_b").withColumnRenamed("offer_brand", "brand_b"), (F.col("sku_b") == F.col("offer_sku")) & F.col("brand_b").eqNullSafe(F.col("offer_brand")))
    return found.select(*candidate("sku_brand", F.col("score"), F.lit("SKU_BRAND"), fuzzy_score=F.col("ratio"), brand_state=F.col("state")))


def bag_of_words(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in encoder: each word counts at the sum of its code points."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in t.split():
            out[i, sum(map(ord, w)) % size] += 1.0
    return out


Encoder = Callable[[list[str]], np.ndarray]


def encoded(df: DataFrame, column: str, encoder: Encoder, name: str) -> DataFrame:
    """Distinct texts and their vectors of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder(batch.column(0).to_pylist()).astype(np.float64)
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=[column, name])

    return df.select(column).distinct().mapInArrow(run, f"{column} string, {name} array<double>")


def similar(left: DataFrame, right: DataFrame, least: float, block_bytes: int = 64 << 20, right_rows: int = 8192) -> DataFrame:
    """left_key, right_key, cosine of all pairs of vectors of length one at or above ``least`` (of four places).

    left (left_key, left_vec) should be the smaller side. It is written to the shared folder, and a
    task meets its blocks, one at a time, with as much of the right side; a larger left side
    makes more blocks. In a block only pairs are computed that its index, or its cells, leave open.
    """
    blocks = Spool(left.select("left_key", "left_vec"), block_bytes)
    kind = dict(left.dtypes)["left_key"], dict(right.dtypes)["right_key"]
    bound = least - 0.00005

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        flat = vectors.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)

    def multiplied(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        keys, other = rows.column(0).combine_chunks(), matrix(rows.column(1))
        for names, block in blocks.blocks(lambda t: (t.column(0).combine_chunks(), Block(matrix(t.column(1)), bound))):
            for i in range(0, len(other), right_rows):
                for r, c, cosine in block.pairs(other[i : i + right_rows]):
                    good = np.round(np.clip(cosine, 0, 1), 4) >= least
                    r, c = r[good], c[good]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), keys.take(pa.array(r + i)), pa.array(cosine[good])], names=["left_key", "right_key", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= block_bytes:
                yield from multiplied(held)
                held, size = [], 0
        if held:
            yield from multiplied(held)

    return right.select("right_key", "right_vec").mapInArrow(run, f"left_key {kind[0]}, right_key {kind[1]}, cosine double")


def semantic(catalog: DataFrame, offers: DataFrame, prior: DataFrame | None = None, min_confidence: float = 0.60, encoder: Encoder = bag_of_words, by_pair: bool = False) -> DataFrame:
    """Cosine of product texts. What ``prior`` candidates settle is left out: whole products, or,
    ``by_pair``, offers whose source_id is settled for the product."""
    left = catalog.select(F.col("row_idx").alias("catalog_idx"), text.product_text(F.col("brand"), F.col("title"), F.col("category")).alias("left_key"))
    right = offers.select(F.col("row_idx").alias("offer_idx"), "source_id", text.product_text(F.col("brand"), F.col("title")).alias("right_key"))
    sure = None if prior is None else prior.where(F.col("confidence") >= CONFIDENT)
    if sure is not None and not by_pair:
        left = left.join(sure.select("catalog_idx").distinct(), "catalog_idx", "left_anti")
    close = similar(encoded(left, "left_key", encoder, "left_vec"), encoded(right, "right_key", encoder, "right_vec"), min_confidence)
    found = close.join(left, "left_key").join(right, "right_key")
    if sure is not None and by_pair:
        settled = sure.select("catalog_idx", "offer_idx").join(offers.select(F.col("row_idx").alias("offer_idx"), "source_id"), "offer_idx").select("catalog_idx", "source_id").distinct()
        found = found.join(settled, ["catalog_idx", "source_id"], "left_anti")
    score = F.round(F.least(F.greatest(F.col("cosine"), F.lit(0.0)), F.lit(1.0)), 4)
    return found.select(*candidate("semantic", score, F.lit("SEMANTIC"), cosine=F.col("cosine")))


def of_pairs(pairs: DataFrame, min_confidence: float = 0.60, encoder: Encoder = bag_of_words) -> DataFrame:
    """Candidates of all layers for given pairs of a product and an offer that was found for it alone.

    ``pairs`` has catalog_idx, offer_idx, source_id, and of either side, with a_ and b_ before them, brand,
    title, category, sku, ean and gtin. Meaning is compared but for offers whose source_id an
    identifier or SKU settles for the product.
    """
    code = lambda f, side, name: f(F.col(f"{side}_{name}"))
    rows = pairs.select(
        "catalog_idx", "offer_idx", "source_id", *(code(text.brand, x, "brand").alias(f"{x}_brand") for x in "ab"), *(code(identifiers.sku, x, "sku").alias(f"{x}_sku") for x in "ab"), *(code(identifiers.ean, x, "ean").alias(f"{x}_ean") for x in "ab"), *(code(identifiers.gtin, x, "gtin").alias(f"{x}_gtin") for x in "ab"),
        text.product_text(F.col("a_brand"), F.col("a_title"), F.col("a_category")).alias("left_key"), text.product_text(F.col("b_brand"), F.col("b_title")).alias("right_key"),
    )
    conflict = F.coalesce(F.col("a_brand") != F.col("b_brand"), F.lit(False))
    kind = F.when(F.col("a_ean") == F.col("b_ean"), "ean").when(F.col("a_gtin") == F.col("b_gtin"), "gtin")
    coded = rows.withColumn("kind", kind).where("kind is not null")
    exact = coded.select(*candidate("exact_id", F.when(conflict, EXACT_CONFLICT).otherwise(EXACT), F.concat(F.lit("EXACT_"), F.upper("kind")), matched_on=F.col("kind"), identifier=F.when(F.col("kind") == "ean", F.col("a_ean")).otherwise(F.col("a_gtin")), brand_conflict=conflict))
    boost = F.when(conflict, CONFLICT).when(F.col("a_brand") == F.col("b_brand"), SAME).otherwise(UNKNOWN)
    named = rows.where("a_sku <> '' and b_sku <> ''").withColumn("ratio", indel_ratio("a_sku", "b_sku")).withColumn("boost", boost)
    state = F.when(F.col("boost") == SAME, "match").when(F.col("boost") == UNKNOWN, "unknown").otherwise("conflict")
    by_sku = named.select(*candidate("sku_brand", F.round(F.col("ratio") * F.col("boost"), 4), F.lit("SKU_BRAND"), fuzzy_score=F.col("ratio"), brand_state=state))
    found = exact.unionByName(by_sku)
    sure = found.where(F.col("confidence") >= CONFIDENT).select("catalog_idx", "offer_idx").join(rows.select("catalog_idx", "offer_idx", "source_id"), ["catalog_idx", "offer_idx"]).select("catalog_idx", "source_id").distinct()
    open_ = rows.join(sure, ["catalog_idx", "source_id"], "left_anti")
    both = open_.join(encoded(open_, "left_key", encoder, "left_vec"), "left_key").join(encoded(open_, "right_key", encoder, "right_vec"), "right_key")
    cosine = F.aggregate(F.zip_with("left_vec", "right_vec", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    meant = both.withColumn("cosine", cosine)
    score = F.round(F.least(F.greatest(F.col("cosine"), F.lit(0.0)), F.lit(1.0)), 4)
    by_meaning = meant.select(*candidate("semantic", score, F.lit("SEMANTIC"), cosine=F.col("cosine")))
    return found.unionByName(by_meaning).where(F.col("confidence") >= min_confidence)


def deduplicated(candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """The most confident candidate of each product and (source, source_id), the earlier one of equals.

    first_met tells where the pair was first met, and orders equal confidences. A layer meets pairs that it
    scores too low to be candidates: that of SKUs every offer with a SKU, that of meaning any.
    """
    met = F.when(identifiers.sku(F.col("sku")) != "", 1).otherwise(2) if "sku" in offers.columns else F.lit(2)
    rows = candidates.join(offers.select(F.col("row_idx").alias("offer_idx"), "source", "source_id", met.alias("met_")), "offer_idx")
    pair = Window.partitionBy("catalog_idx", "source", "source_id")
    rows = rows.withColumn("first_met", F.min(F.struct(F.least("layer_ord", "met_").alias("layer_ord"), "offer_idx")).over(pair)).drop("met_")
    best = pair.orderBy(F.col("confidence").desc(), "layer_ord", "offer_idx")
    return rows.withColumn("n_", F.row_number().over(best)).where("n_ = 1").drop("n_")


def judged(candidates: DataFrame, min_confidence: float = 0.60, dealt: bool = False) -> DataFrame:
    """With status accepted or rejected, the rank among a product's accepted ones, and its level.

    With ``dealt`` the candidates are written once, and a product with a large share of them is ranked by several
    tasks; without, each product is ranked by one, of whose candidates a caller that wants the best reads only those.
    """
    accepted = F.col("confidence") >= min_confidence
    rows = candidates.withColumn("status", F.when(accepted, "accepted").otherwise("rejected")).withColumn("confidence_level", confidence_level(F.col("confidence")))
    group, order = ["catalog_idx", "status"], [F.col("confidence").desc(), F.col("first_met").asc(), F.col("offer_idx").asc()]
    if dealt:
        return placed(rows, group, order).withColumnRenamed("place", "cand_rank")
    return rows.withColumn("cand_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence > 0.90, "HIGH").when(confidence >= 0.70, "MEDIUM").otherwise("LOW")


def reviewed(candidates: DataFrame, verdicts: DataFrame, min_confidence: float = 0.60) -> DataFrame:
    """Apply a reviewer's verdicts (catalog_idx, offer_idx, is_match, adjustment, and perhaps reason and failure).

    No verdict leaves a candidate as it is; an adjustment lies in [-0.3, 0.1]. A match is
    AI_VERIFIED; what is none, or falls under min_confidence, is rejected. ``review`` tells the verdict, or
    that the reviewer skipped the candidate and why. Ranks stay as they were.
    """
    given = [c for c in ("reason", "failure") if c in verdicts.columns]
    rows = candidates.drop("review").join(verdicts.select("catalog_idx", "offer_idx", "is_match", "adjustment", *given), ["catalog_idx", "offer_idx"], "left")
    for c in {"reason", "failure"} - {*given}:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    move = F.least(F.greatest(F.coalesce("adjustment", F.lit(0.0)), F.lit(-0.3)), F.lit(0.1))
    changed = F.round(F.least(F.greatest(F.col("confidence") + move, F.lit(0.0)), F.lit(1.0)), 4)
    open_ = (F.col("status") == "accepted") & F.col("is_match").isNotNull()
    skipped = (F.col("status") == "accepted") & F.col("failure").isNotNull()
    told = F.struct(F.when(skipped, "skipped").alias("ai_gate"), F.when(skipped, F.col("failure")).alias("ai_error"), F.when(open_, F.col("is_match")).alias("ai_is_match"), F.when(open_, F.round(move, 4)).alias("ai_confidence_adjustment"), F.when(open_, F.col("reason")).alias("ai_reason"))
    rows = rows.withColumn("review", F.when(open_ | skipped, told))
    rows = rows.withColumn("confidence", F.when(open_, changed).otherwise(F.col("confidence")))
    rows = rows.withColumn("match_method", F.when(open_ & F.col("is_match"), "AI_VERIFIED").otherwise(F.col("match_method")))
    if "confidence_level" in rows.columns:
        rows = rows.withColumn("confidence_level", confidence_level(F.col("confidence")))
    keep = F.coalesce("is_match", F.lit(True)) & (F.col("confidence") >= min_confidence)
    return rows.withColumn("status", F.when((F.col("status") == "accepted") & keep, "accepted").otherwise("rejected")).drop("is_match", "adjustment", "reason", "failure")


def rejected_counts(catalog: DataFrame, offers: DataFrame, exact: DataFrame, accepted: DataFrame, sure: DataFrame | None = None, by_pair: bool = False, with_meaning: bool = True) -> DataFrame:
    """catalog_idx, rejected_count, without making rejected rows: what the layers met of a product less what is accepted.

    An offer here is a (source, source_id). The first layer meets those of equal identifiers (``exact``), that of SKUs all with a
    SKU if the product has one, that of meaning all; but ``sure`` candidates settle their whole product, or, ``by_pair``, the offers
    of their source_id, and what is settled is not compared by meaning. Two numbers go to the driver.
    """
    pair = ["source", "source_id"]
    sides = offers.groupBy(*pair).agg(F.bool_or(F.coalesce(identifiers.sku(F.col("sku")) != "", F.lit(False))).alias("named_"))
    total = sides.agg(F.count("*").alias("every"), F.count_if("named_").alias("named")).first()
    products = catalog.select(F.col("row_idx").alias("catalog_idx"), F.coalesce(identifiers.sku(F.col("sku")) != "", F.lit(False)).alias("own_"))
    ids = offers.select(F.col("row_idx").alias("offer_idx"), *pair)
    by_id = exact.select("catalog_idx", "offer_idx").join(ids, "offer_idx").select("catalog_idx", *pair).distinct()
    no_sku = lambda rows: rows.join(products, "catalog_idx").where("not (named_ and own_)")
    counted = lambda rows, name: rows.groupBy("catalog_idx").agg(F.count("*").alias(name))
    n = F.when(F.col("own_"), total.named).otherwise(0) + F.coalesce("extra_", F.lit(0))
    rows = products.join(counted(accepted, "accepted_"), "catalog_idx", "left").join(counted(no_sku(by_id.join(sides, pair)), "extra_"), "catalog_idx", "left")
    if with_meaning and sure is None:
        n = F.lit(total.every)
    elif with_meaning and by_pair:
        settled = sure.select("catalog_idx", "offer_idx").join(ids, "offer_idx").select("catalog_idx", "source_id").distinct()
        unmet = no_sku(settled.join(sides, "source_id")).join(by_id, ["catalog_idx", *pair], "left_anti")
        rows, n = rows.join(counted(unmet, "unmet_"), "catalog_idx", "left"), F.lit(total.every) - F.coalesce("unmet_", F.lit(0))
    elif with_meaning:
        rows = rows.join(sure.select("catalog_idx").distinct().withColumn("settled_", F.lit(True)), "catalog_idx", "left")
        n = F.when(F.col("settled_"), n).otherwise(total.every)
    return rows.select("catalog_idx", (n - F.coalesce("accepted_", F.lit(0))).cast("long").alias("rejected_count"))


def match_field(layer: Column) -> Column:
    return F.when(layer == "exact_id", "gtin").when(layer == "sku_brand", "sku").otherwise("snippet")


def confidence_tier(layer: Column, fuzzy_score: Column, source: Column) -> Column:
    sku = F.when(F.coalesce(fuzzy_score, F.lit(0.0)) >= 0.999, "PDP·SKU").otherwise("PDP·SKU·norm")
    meaning = F.when(source == "oxylabs", "title(oxy)").otherwise("snippet")
    return F.when(layer == "exact_id", "PDP·GTIN").when(layer == "sku_brand", sku).otherwise(meaning)
