"""The thin queries over whole tables, one for each operator, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, curriculum, decontaminate, disclosure, guess_cost, lattice, licenses, line_crf, severity, simhash, snapshots, sstable, vantage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), sstable.tokenizer_path(spark))
    return sstable.read_shards(manifest)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = line_crf.fit(line_crf.sample(docs, table(spark, sf_dir, "labels")))
    return line_crf.apply_rules(docs, chain, keep=["doc_id"])


def span_text(spans, base_only: bool = False):
    """kind:start:end of spans in their order, comma-joined."""
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    parts = F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guess_cost.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [counted("spans", k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(span_text("spans", True), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.chat_rows(table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the hash of the sanitised text, null for a null text."""
    found = disclosure.find_disclosures(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [counted("spans", k) for k in disclosure.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("spans", True), 256).alias("base_sha256"), span_text("spans").alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op10_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels say only toxic or not: the grades above 1 are derived from how many marked words a toxic text holds."""
    docs = table(spark, sf_dir, "documents")
    model = severity.fit(severity.sample(docs, table(spark, sf_dir, "labels")))
    return severity.score(docs, model, keep=["doc_id"])


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    moved = rows.withColumn("label", F.when(F.expr("vec_id % 7 = 0"), (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return vantage.mine(moved, F.expr("vec_id % 100 = 0"))


QUERIES = (
    op1_decontaminate,
    op2_simhash,
    op3_license_scan,
    op4_token_shards,
    op5_line_quality,
    op6_secret_scan,
    op7_mix_sources,
    op8_chat_snapshots,
    op9_pii,
    op10_toxic_severity,
    op11_centroid_clusters,
    op12_embedding_dedup,
    op13_hard_negatives,
)

OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations GROUP BY ALL
), hashed AS (
  SELECT conv_id, turn, md5(concat(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST), '/', role, '/', text)) AS h FROM rows_
), rolled AS (
  SELECT DISTINCT conv_id, turn,
         count(*) OVER w AS n,
         list_sort(list(h) OVER w) AS hs,
         count(*) OVER (PARTITION BY conv_id) AS n_all
  FROM hashed WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)
), prefixes AS (
  SELECT conv_id, n, md5(array_to_string(hs, ',')) AS s, n_all FROM rolled
), longest AS (
  SELECT n, s, min(struct_pack(length := -n_all, conv := conv_id)) AS best FROM prefixes GROUP BY n, s
), kept AS (
  SELECT p.conv_id FROM prefixes p JOIN longest l USING (n, s)
  WHERE p.n = p.n_all AND l.best.length = -p.n_all AND l.best.conv IS NOT DISTINCT FROM p.conv_id
)
SELECT r.conv_id, turn, role, role = 'assistant' AS trainable,
       concat('<|', regexp_replace(role, '[<|>\r\n]', '_', 'g'), '|>', chr(10), replace(text, '<|', '< |'), '<|end|>', chr(10)) AS rendered
FROM rows_ r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), hashed AS (
  SELECT *, md5(concat(coalesce(doc_id::VARCHAR, '-'), '/', size)) AS h FROM docs
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_ FROM hashed
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS k, (6 * sum(source_size) OVER () - 4 * coalesce(sum(cap) OVER before, 0))::BIGINT AS left_,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_ AS (
  SELECT k AS k_, rank AS rank_, left_::DOUBLE / (4 * open_weight) AS level FROM levels
  WHERE left_ * weight <= cap * 4 * open_weight ORDER BY k, rank LIMIT 1
), targets AS (
  SELECT source, source_size, rank, CASE WHEN (k, rank) >= (k_, rank_) THEN level * weight ELSE cap::DOUBLE END AS target
  FROM levels LEFT JOIN first_ ON TRUE
), planned AS (
  SELECT s.doc_id, s.size, s.begin_, t.source_size, t.rank, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS whole
  FROM streams s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + (begin_ + size / 2 < target - whole * source_size)::BIGINT END AS copies,
         least((begin_ + size / 2) / greatest(target, 1.0), 1.0) AS c
  FROM planned
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL ELSE least(greatest(CASE rank % 3
         WHEN 0 THEN (sqrt(greatest(0.0, 2.25 + c * -2.0)) - 1.5) / -1.0
         WHEN 1 THEN (sqrt(greatest(0.0, 0.25 + c * 2.0)) - 0.5) / 1.0
         ELSE c END, 0.0), 1.0) END AS first_position
FROM copied
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_mix_sources": OP7_SQL, "op8_chat_snapshots": OP8_SQL}
