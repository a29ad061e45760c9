"""From raw documents to token shards: five stages, each written as Parquet and read by the next.

    toxicity       documents whose expected grade passes the model's limit go
    near-dedup     one document of each SimHash group stays
    decontaminate  passages of the benchmark are cut; a document of nothing else goes
    mix            documents are repeated or left out to meet the sources' targets, in training order
    token shards   the mix as token ids in sorted-string tables, read back
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import curriculum, decontaminate, severity, simhash, sstable
from linkwright.operators.shared import new_folder

#: SQL cannot express a model fit, XXH64, or byte-pair encoding; tests hold each stage against brute force.
ORACLE_SQL = None
#: The columns of documents that some stage reads; all others only pass through.
OWN = ("doc_id", "text", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing(stage: Stage) -> Stage:
    """The stage with the other columns under names that clash with no operator's, and theirs again after it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"other_{i}_" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run


@passing
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, does not take for toxic.

    A null or empty text stays; repeated rows stay or go together; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return severity.score(docs, severity.fit(severity.sample(docs, labels))).where("not toxic")


@passing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, documents without one last.

    Texts without words are one group, null or not; repeated rows are copies; texts that are no near
    copies stay, whatever their ids.
    """
    return simhash.keep_representatives(docs)


@passing
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's passages cut; one of nothing else goes.

    n_chars follows a cut text, and any other stays as it is. A null or wordless text stays, and so
    does every document where the benchmark is empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark).where("n_hit = 0 or n_hit < n_words")
    clean = decontaminate.remove_spans(found)
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")))


@passing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the plan takes of a document, in training order.

    A document without words is never taken; null sources are one source; repeated rows have copies each.
    """
    return curriculum.training_order(docs, curriculum.mix(docs))


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the mix, from its shards; a row for each copy, null ids first."""
    return sstable.read_shards(sstable.write_shards(docs, sstable.tokenizer_path(spark)))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
