"""Each stage of the pipeline, and the whole, on the small tables, on odd ones, and on empty ones."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import curriculum, severity, sstable

from . import brute
from .test_contracts import documents, empty, folder, odd  # noqa: F401


def table(spark, folder, name="documents"):  # noqa: F811
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows_of(df):
    return Counter(map(str, df.collect()))


def crowded(docs):
    """With columns of the names that operators give to theirs."""
    names = ("severity", "grade", "toxic", "spans", "N_Words", "n_hit", "items", "positions_", "position", "row", "doc", "key", "fp", "root", "other_0_", "copies", "size", "start")
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {n}").alias(n) for n in names))


def test_toxicity(spark, folder):  # noqa: F811
    docs = table(spark, folder)
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    model = severity.fit(severity.sample(docs, table(spark, folder, "labels")))
    toxic = lambda t: sum(model.weights.get(w.encode(), 0.0) for w in set(brute.item_words(t))) >= model.thresholds[0]
    assert kept.schema == docs.schema and rows_of(kept) == Counter(str(r) for r in docs.collect() if not toxic(r.text))


def test_near_dedup(spark, folder):  # noqa: F811
    docs = table(spark, folder)
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    rows = docs.collect()
    groups = brute.near_groups([(k, r.text) for k, r in enumerate(rows)])
    root = {str(r): g for r, (_, g) in zip(rows, groups, strict=True)}
    left = kept.collect()
    assert kept.schema == docs.schema and Counter(root[str(r)] for r in left) == Counter({g for _, g in groups})
    least = {}
    for r, (_, g) in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert all(least[root[str(r)]] == (r.doc_id is None, r.doc_id or 0) for r in left)


def test_decontamination(spark, folder):  # noqa: F811
    docs, bench = table(spark, folder), pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    kept = corpus_pipeline.decontamination(spark, docs, folder)
    items = [(b["item_id"], b["text"]) for b in bench]
    want = []
    for r in docs.collect():
        n, hit, _, _ = brute.decontaminated([(r.doc_id, r.text)], items)[0]
        if hit == 0:
            want.append((r.doc_id, r.text, r.n_chars))
        elif hit < n:
            clean = brute.without_passages(r.text, items)
            want.append((r.doc_id, clean, len(clean)))
    assert kept.schema == docs.schema and Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == Counter(want)


def test_mix(spark, folder):  # noqa: F811
    docs = table(spark, folder)
    order = corpus_pipeline.mix(spark, docs, folder)
    copies = Counter()
    for r in curriculum.mix(docs).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(brute.RUNS.findall(r.text or ""))) for r in order.collect())
    assert order.schema == docs.schema and got == +copies and rows_of(order).keys() <= rows_of(docs).keys()


def test_token_shards(spark, folder):  # noqa: F811
    rows = corpus_pipeline.token_shards(spark, table(spark, folder), folder).collect()
    want = brute.token_rows(documents(folder), sstable.tokenizer_path(spark))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, n, c) for d, _, n, c in want)
    assert sorted(r.start for r in rows) == [s for _, s, _, _ in want]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_other_columns_pass(spark, odd, name):  # noqa: F811
    docs = crowded(table(spark, odd))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, odd)
    assert out.schema == docs.schema and out.count()
    assert all(set(v for v in r if isinstance(v, str) and re.match("own ", v)) == {f"own {n}" for n in docs.columns[5:]} for r in out.collect())


def test_run(spark, folder):  # noqa: F811
    out = corpus_pipeline.run(spark, folder)
    docs = table(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = brute.token_rows([(r.doc_id, r.text) for r in docs.collect()], sstable.tokenizer_path(spark))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out.collect()) == Counter((d, n, c) for d, _, n, c in want)


def test_empty(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert all(stage(spark, table(spark, empty), empty).collect() == [] for _, stage in corpus_pipeline.STAGES)
