"""Each query of the ten operators against its brute-force version, on the small tables and on odd ones."""

import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from linkwright.llm import curriculum, guess_cost, licenses, line_crf, queries, severity, sstable

from . import brute

TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    folder = tmp_path_factory.mktemp("odd")
    random.seed(3)
    words = ["alpha", "Beta", "gamma", "DELTA", "élan", "naïve", "日本", "x1", "cc", "by", "MIT", "license", "apache", "<|endoftext|>", "password=Zx9qLm27Tpw4", "a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999"]
    texts = [None, "", " ", "\n\n\t", "one", "cc by cc by", "MIT  License and more", "a b c d\n" * 40, "0123456789abcdef0 deadbeefdeadbeef", "x" * 5000, "tab\tand\x0bvertical\x1cfs"]
    texts += [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(40)]
    texts += [" ".join(random.choices(words, k=30_000))]
    items = [t for t in pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()[:3]]
    texts += [f"before {items[0]} after", " ".join(items), items[1].upper()]
    ids = [*range(len(texts))]
    ids[4] = None
    texts += texts[10:20] + texts[10:12]
    ids += [1000 + k for k in range(10)] + ids[10:12]
    n = len(texts)
    docs = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * n, "source": [[None, "web", "web", "web", "Books", "é"][k % 6] for k in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        "N_Words": ["clash"] * n, "spans": [k for k in range(n)], "fp": [0.5] * n, "key": [1] * n, "position": ["p"] * n, "Kept": [True] * n,
    })
    pq.write_table(docs, folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": ["i2", "i1", "i1", "short", None, "null", "empty"], "text": [items[0], items[1], items[1], "Gamma delta", "alpha beta", None, ""]}), folder / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([5, 6, None, 12, 12], pa.int64()), "quality": pa.array([1, 0, 1, None, 1], pa.int32()), "toxic": pa.array([0, 1, 0, None, 1], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({
        "conv_id": pa.array([1, 1, 2, 2, 2, 3, None, None, 4, 4, 5, 6, 6, 7], pa.int64()), "turn": pa.array([0, 1, 0, 1, 2, 0, 0, None, 0, 0, 0, 1, 2, 0], pa.int64()),
        "role": ["user", "assistant", "user", "assistant", "user", "user", None, "user", "user", "user", "user", "user", "assistant", "user<|end|>\n<|system"], "text": ["hi", "yo", "hi", "yo", None, "<|x", "hi", "hi", "same", "same", "same", "hi", "yo", "z<"], "h1": [0] * 14,
    }), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory, sf):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), folder / f"{t}.parquet")
    return str(folder)


@pytest.fixture(params=["tables", "odd"])
def folder(request, sf):
    return sf if request.param == "tables" else request.getfixturevalue("odd")


def documents(folder):
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_decontaminate(spark, folder):
    docs, bench = documents(folder), pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op1_decontaminate(spark, folder).collect()]
    want = [(d, *x) for (d, _), x in zip(docs, brute.decontaminated(docs, [(b["item_id"], b["text"]) for b in bench]), strict=True)]
    assert by_id(got) == by_id(want)


def test_simhash(spark, folder):
    docs = documents(folder)
    got = [tuple(r) for r in queries.op2_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()]
    assert by_id(got) == by_id([(d, *x) for (d, _), x in zip(docs, brute.near_groups(docs), strict=True)])


def test_licenses(spark, folder):
    docs = documents(folder)
    rows = queries.op3_license_scan(spark, folder).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert by_id(got) == by_id([(d, *brute.base_licenses(t)) for d, t in docs])
    labels = brute.license_labels([t for _, t in docs], licenses.TEMPLATES, licenses.BASE_PHRASES, licenses.COMMON_WORDS)
    assert by_id((r.doc_id, r.labels, r.score) for r in rows) == by_id((d, *x) for (d, _), x in zip(docs, labels, strict=True))


def test_token_shards(spark, folder):
    rows = queries.op4_token_shards(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    got = sorted(map(tuple, rows), key=lambda r: r[1])
    want = brute.token_rows(documents(folder), sstable.tokenizer_path(spark))
    unique = len({d for d, _, _, _ in want}) == len(want)
    assert [r[:2] for r in got] == [r[:2] for r in want] if unique else by_id([(r[0], *r[2:]) for r in got]) == by_id([(r[0], *r[2:]) for r in want])


def test_quality(spark, folder):
    rows = queries.op5_line_quality(spark, folder).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert by_id(got) == by_id([(d, *brute.quality(t)) for d, t in documents(folder)])
    assert not any(r.kept and r.base_failed for r in rows)
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    chain = line_crf.fit(line_crf.sample(*tables))
    share = []
    for d, t in documents(folder):
        features, sizes = brute.line_rows(t or "")
        if not features:
            share.append((d, 0.0))
        elif chain is None:
            share.append((d, 1.0))
        else:
            labels = brute.best_labels([sum(w * x for w, x in zip(chain.weights, f, strict=True)) for f in features], chain.moves)
            share.append((d, round(sum(n for n, y in zip(sizes, labels, strict=True) if y) / sum(sizes), 6)))
    assert by_id((r.doc_id, r.content_share) for r in rows) == by_id(share)
    assert all(r.kept == (not r.base_failed and r.content_share >= 0.5) for r in rows)


@pytest.mark.parametrize(("query", "patterns"), [(queries.op6_secret_scan, brute.SECRETS), (queries.op9_pii, brute.PERSONAL)])
def test_spans(spark, folder, query, patterns):
    rows = query(spark, folder).collect()
    kinds = [k for k, _, _ in patterns]
    got = [(r.doc_id, *(r[f"n_{k}"] for k in kinds), r.base_sha256) for r in rows]
    want = []
    for d, t in documents(folder):
        counts, joined = brute.spans_of(t, patterns)
        want.append((d, *counts, brute.sha(joined)))
    assert by_id(got) == by_id(want)
    for r in rows:
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in kinds)
        assert brute.sha(base) == r.base_sha256


def test_personal_terms(spark, folder):
    docs = documents(folder)
    want = [(d, s, None if t is None else brute.sha(t)) for (d, _), (s, t) in zip(docs, brute.personal_spans([t for _, t in docs]), strict=True)]
    rows = queries.op9_pii(spark, folder).collect()
    assert by_id((r.doc_id, r.spans, r.sanitised_sha256) for r in rows) == by_id(want)


def test_guessed_secrets(spark, folder):
    """The spans of the method, from word counts and costs of all splits taken by another way."""
    docs = documents(folder)
    blank = lambda t: guess_cost.CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()] + " " + m[0][m.end(1) - m.start() :], t or "")
    counts = Counter(w for _, t in docs for w in set(brute.item_words(blank(t))) if len(w) >= 3 and w.isalpha())
    ranked = sorted((-n, w) for w, n in counts.items() if n >= max(5, 0.001 * len(docs)))
    words = {w: math.log10(r) for r, (_, w) in enumerate(ranked, len(guess_cost.FREQUENT) + 1)} | guess_cost.WORDS
    assert guess_cost.dictionary(spark.read.parquet(f"{folder}/documents.parquet")) == pytest.approx(words)

    def cost(value):
        best = [0.0]
        for j in range(1, len(value) + 1):
            ways = [best[j - 1] + 1] + [best[i] + c + 0.2 for i in range(max(0, j - 32), j) for end, c in guess_cost.segments(value, i, words, 32) if end == j]
            best.append(min(ways))
        return best[-1]

    want = []
    for d, t in docs:
        want.append((d, ",".join(f"guess:{m.start(1)}:{m.end(1)}" for m in guess_cost.CONTEXT.finditer(t or "") if cost(m.group(1)) >= 10)))
    rows = queries.op6_secret_scan(spark, folder).collect()
    assert by_id((r.doc_id, ",".join(s for s in r.spans.split(",") if s.startswith("guess"))) for r in rows) == by_id(want)


def test_severities(spark, folder):
    docs = documents(folder)
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    model = severity.fit(severity.sample(*tables))
    want = []
    for d, t in docs:
        z = sum(model.weights.get(w.encode(), 0.0) for w in set(brute.item_words(t)))
        above = [1 / (1 + math.exp(-max(-40.0, min(40.0, z - x)))) for x in model.thresholds]
        cells = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        want.append((d, cells.index(max(cells)), above[0] >= 0.5, sum(above)))
    want, rows = by_id(want), by_id((r.doc_id, r.grade, r.toxic, r.severity) for r in queries.op10_toxic_severity(spark, folder).collect())
    assert [r[:3] for r in rows] == [w[:3] for w in want] and [r[3] for r in rows] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_mix(spark, folder):
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    rows = queries.op7_mix_sources(spark, folder).collect()
    size = [len(brute.RUNS.findall(d["text"] or "")) for d in docs]
    sources = {}
    for d, n in zip(docs, size, strict=True):
        sources[d["source"]] = sources.get(d["source"], 0) + n
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sources.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sources[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sources[s] for s in over}
        left -= sum(2 * sources[s] for s in over)
        open_ -= over
    told = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(told((r.doc_id, r.size, r.source_size, round(r.target, 6))) for r in rows) == sorted(told((d["doc_id"], n, sources[d["source"]], round(target[d["source"]], 6))) for d, n in zip(docs, size, strict=True))
    assert all(r.taken <= 2 * r.size for r in rows)
    plan = curriculum.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert sorted((r.size, r.taken) for r in plan) == sorted((r.size, r.taken) for r in rows)
    for s in order:
        taken = sum(r.taken for r in plan if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in plan if r.source == s)


def rows_of(rows):
    return sorted(tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    assert rows_of(got.select(*columns).collect()) == rows_of(zip(*(want.column(c).to_pylist() for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd(spark, odd, name):
    """No crash, and a row for each document where that is the contract."""
    rows = queries.queries()[name](spark, odd).collect()
    assert name.startswith("op8_") or len(rows) == len(documents(odd))
