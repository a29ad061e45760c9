"""Parts of the operators: learned models on held-out rows, exact round trips, and properties."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.llm import curriculum, decontaminate, disclosure, guess_cost, line_crf, severity, simhash, snapshots, sstable

ROWS = 4000


@pytest.fixture(scope="module")
def halves(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")


def test_severity_held_out(halves):
    docs, train, other = halves
    model = severity.fit(severity.sample(docs, train))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = severity.score(docs.join(other, "doc_id"), model, keep=["doc_id"]).withColumnRenamed("toxic", "said").join(other, "doc_id").where("toxic is not null").collect()
    toxic = [r.said for r in rows if r.toxic == 1]
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(r.said for r in rows if r.toxic == 0) < 0.02 * len(rows)


def test_chain_held_out(halves):
    docs, train, other = halves
    chain = line_crf.fit(line_crf.sample(docs, train, max_rows=1500))
    rows = line_crf.apply_rules(docs.join(other, "doc_id"), chain, keep=["doc_id", "quality"]).where("not base_failed and quality is not null").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.95 * len(rows)


def test_ordinal_gradient():
    rng = np.random.default_rng(3)
    r, c = rng.integers(0, 40, 120), rng.integers(0, 6, 120)
    grade, at = rng.integers(0, severity.GRADES + 1, 40), rng.normal(size=6 + severity.GRADES) / 3
    value = lambda x: severity.gradient(x[:6], x[6], x[7:], r, c, grade, 0.05)
    numeric = [(value(at + e)[0] - value(at - e)[0]) / 2e-5 for e in np.eye(len(at)) * 1e-5]
    assert value(at)[1] == pytest.approx(np.array(numeric), abs=1e-4)


def test_sample_does_not_depend_on_the_order_of_rows(spark):
    docs = [(i % 30, f"w{i % 7} x{i % 5} bad{i % 2}", i) for i in range(90)]
    labels = [(i, i % 2, (i + 1) % 2) for i in range(30)] + [(3, 0, 0), (4, 1, 1), (None, 1, 1)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4)
    one, two = ((made(d, "doc_id long, text string, text2 int"), made(x, "doc_id long, toxic int, quality int")) for d, x in ((docs, labels), (docs[::-1], labels[::-1])))
    assert severity.sample(*one) == severity.sample(*two)
    assert [(x.tolist(), y) for x, y in line_crf.sample(*one)] == [(x.tolist(), y) for x, y in line_crf.sample(*two)]
    assert len(severity.sample(*one, max_rows=10).texts) == 10 and len(severity.sample(*one, max_words=2, min_docs=1).vocab) <= 2


def test_lines_of_spliced_documents(halves):
    """Held-out good and bad documents end to end: both labels are found, and most lines have their own."""
    docs, train, other = halves
    chain = line_crf.fit(line_crf.sample(docs, train))
    mixed = [(x, y) for x, y in line_crf.spliced(line_crf.sample(docs, other), 2, 9) if 0 < y.mean() < 1]
    got = [chain.decode(x) for x, _ in mixed]
    assert len(mixed) > 200 and sum(0 < g.mean() < 1 for g in got) > 0.85 * len(got)
    assert np.concatenate([g == (y == 1) for g, (_, y) in zip(got, mixed, strict=True)]).mean() > 0.95


def test_half_boilerplate(spark, halves):
    docs, train, _ = halves
    chain = line_crf.fit(line_crf.sample(docs, train))
    good = "\n".join(f"There is a line of plain prose in this place, and it is number {w} of all." for w in ("one", "two", "three", "four", "five"))
    bad = "\n".join("Home | About | Contact | Login | Cart | Help | Terms | Privacy" for _ in range(6))
    rows = spark.createDataFrame([(1, good), (2, bad), (3, f"{good}\n{bad}"), (4, f"{bad}\n{good}")], "doc_id long, text string")
    share = {r.doc_id: r.content_share for r in line_crf.apply_rules(rows, chain, keep=["doc_id"]).collect()}
    size = len(good.replace("\n", "")) / len((good + bad).replace("\n", ""))
    assert share[1] == 1 and share[2] == 0 and share[3] == pytest.approx(size, abs=1e-6) and share[4] == pytest.approx(size, abs=1e-6)


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    chain = line_crf.Chain(tuple(rng.normal(size=len(line_crf.FEATURES))), ((0.5, -0.7), (-0.2, 0.4)))
    for _ in range(20):
        x = rng.normal(size=(6, len(line_crf.FEATURES)))
        emit = x @ np.array(chain.weights)

        def worth(path, emit=emit):
            return sum(e for e, s in zip(emit, path, strict=True) if s) + sum(chain.moves[a][b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=6), key=worth)
        assert worth(tuple(chain.decode(x).astype(int))) == pytest.approx(worth(best))


def test_triples_cover_every_four_positions():
    triples = [set(t) for t in simhash.covering_triples()]
    assert all(any(t <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_hot_posting_is_split(spark):
    random.seed(5)
    base = random.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in random.sample(range(64), 3)) for _ in range(300)})
    rows = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(rows, "fp long")
    whole, split = (simhash.components(simhash.links(fps, posting_rows=n, sample_rate=1)).collect() for n in (10**6, 20))
    groups = lambda rows: {frozenset(r.node for r in rows if r.root == root) for root in {r.root for r in rows}}
    assert groups(whole) == groups(split)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=2), min_size=1, max_size=4))
def test_index_finds_all(runs, patterns):
    text = np.array([x for run in runs for x in [*run, 0]], np.int64)
    index = decontaminate.FMIndex(text, 3)
    lo, hi = index.search(np.array(patterns))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(text) - 1) if text[i : i + 2].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aZé9 日\n\t.,'’!\x1c  <|endoftx>"), max_size=60))
def test_chunks_encode_as_the_whole(text):
    import public_tokenizers

    enc = sstable.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.encode_batch([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_shards_look_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = sstable.tokenizer_path(spark)
    manifest = sstable.write_shards(docs, path, shards=3)
    asked = spark.range(0, 400, 7).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.ids for r in sstable.lookup(manifest, asked).collect()}
    tokenizer = sstable.encoder(path).tokenizer
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.where("doc_id % 7 = 0").collect()}
    assert got == want


def test_repeated_and_missing_keys_look_up(spark):
    rows = [(1, "a"), (1, "b b"), (None, "c"), (None, None), (2, ""), (1, "a")] + [(9, f"x{i}") for i in range(60)] + [(i, "y") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = sstable.tokenizer_path(spark)
    manifest = sstable.write_shards(docs, path, shards=8)
    tokenizer = sstable.encoder(path).tokenizer
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    asked = spark.createDataFrame([(1,), (1,), (None,), (7,), (9,)], "doc_id long")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in sstable.lookup(manifest, asked).collect())
    assert got == sorted((k is not None, k or 0, ids(t)) for k, t in rows if k in (1, None, 9))
    files = manifest.orderBy("place", "part").collect()
    assert sum(sstable.from_key(bytes(f.first_key)) == 9 for f in files) > 3, "a key of most rows is dealt to several shards"
    keys = [sstable.from_key(bytes(k)) for f in files for k in (f.first_key, f.last_key)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    back = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1].tolist()] and len(back) == len(rows)


def test_encoder_memory_is_bounded():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = sstable.Encoder(path, max_chunks=50, max_chars=300, longest=20)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(5)] + ["日" * 2000, "a " + "b" * 21 + " a", "q" * 20]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for t in texts for x in enc.encode_batch([t])] == want
        assert len(enc.at) <= 50 and sum(map(len, enc.at)) <= 300 and max(map(len, enc.at)) <= 20
    assert sstable.cuts_at_space(enc.tokenizer.to_str()) and not sstable.cuts_at_space('{"pre_tokenizer": {"type": "Whitespace"}}')


def test_values_are_judged_one_by_one():
    spans = lambda t: [t[a:b] for a, k, b, _ in guess_cost.find_secrets(t) if k == 3]
    assert spans("user=x;password=hello;pwd=aG8kLm2PqRz9xTw") == ["aG8kLm2PqRz9xTw"]
    assert spans("https://h.it/?token=a&pwd=aG8kLm2PqRz9xTw&x=1") == ["aG8kLm2PqRz9xTw"]
    assert spans("pwd=xkqzvbnmtrplwqyzkjhgf") == ["xkqzvbnmtrplwqyzkjhgf"] and spans("pwd=changeme1 secret: password2024") == []
    assert spans("") == spans(None) == []


def test_long_values_cost_little():
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))
    began = time.time()
    assert guess_cost.guess_cost(noise, most=10.0) >= 10 and guess_cost.guess_cost("a" * 200_000, most=10.0) >= 10 and guess_cost.guess_cost("password" * 20_000, most=10.0) >= 10
    assert time.time() - began < 1


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aab1qwe2024-pas"), min_size=1, max_size=9))
def test_cost_is_that_of_the_cheapest_split(value):
    words = {"pass": 0.5, "was": 1.0}
    pieces = {(i, j): min([c + 0.2 for end, c in guess_cost.segments(value, i, words, 32) if end == j] + [1.0] * (j == i + 1), default=np.inf) for i in range(len(value)) for j in range(i + 1, len(value) + 1)}
    cuts = (itertools.chain([0], c, [len(value)]) for n in range(len(value)) for c in itertools.combinations(range(1, len(value)), n))
    assert guess_cost.guess_cost(value, words) == pytest.approx(min(sum(pieces[p] for p in itertools.pairwise(c)) for c in cuts))


def test_dictionary_grows_with_the_corpus(spark):
    docs = spark.createDataFrame([(i, "Giraffe token=giraffezebra" if i % 3 else "zebra x") for i in range(40)], "doc_id long, text string")
    words = guess_cost.dictionary(docs)
    assert {"giraffe", "zebra"} <= words.keys() and words["giraffe"] < words["zebra"]
    rows = guess_cost.scan_secrets(docs, keep=["doc_id"]).collect()
    assert not any(s.kind == "guess" for r in rows for s in r.spans)


def test_guess_cost():
    cost = guess_cost.guess_cost
    assert cost("password") < 2 and cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 4 and cost("2024-05-17") < 6
    assert cost("password2024aaaa") < 10 < cost("x9Q!rT2$vLp8")
    assert cost("x9Q!rT2$vLp8") <= 12
    assert [k for _, k, _, _ in guess_cost.find_secrets('pwd = "x9Qvr-T2$vLp8" pwd = "changeme1"')] == [3]


def test_disclosing_term(spark):
    rows = [(i, f"please contact zanzibar team at boss@acme.com number {i}") for i in range(6)] + [(50, "far from any address stands Zanzibar too"), (51, None)]
    rows += [(100 + i, f"please contact nobody about team number {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("doc", F.lit("x"))
    found = {r.doc_id: r for r in disclosure.find_disclosures(docs, keep=["doc_id"]).collect()}
    words = {rows[i][1][s.start : s.end] for i in range(6) for s in found[i].spans}
    assert words == {"boss@acme.com", "zanzibar"} and not any(found[100 + i].spans for i in range(600))
    assert found[50].sanitised == "far from any address stands <TERM> too" and found[51].sanitised is None
    clean = disclosure.sanitise(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.where("doc_id = 3").collect()} == {"please contact <TERM> team at <EMAIL> number 3"}
    assert {(r.spans, r.doc) for r in clean.collect()} == {(1, "x")}
    tiny = disclosure.find_disclosures(docs, keep=["doc_id"], block_bytes=1)
    assert {r.doc_id: r for r in tiny.collect()} == found


def test_overlapping_spans_go_under_the_first_kind():
    assert disclosure.generalised("call +1 555 010 9999 now", [(5, 3, 20), (6, 2, 20)]) == "call <PHONE> now"
    assert disclosure.generalised("", []) == "" and disclosure.generalised(None, []) is None


def test_snapshots(spark):
    rows = [(c, t, "user", x) for c, talk in {1: "ab", 2: "abc", 3: "abc", 4: "x", 5: "abd", 6: "ab"}.items() for t, x in enumerate(talk)]
    rows += [(7, t, "user", str(t)) for t in range(200)] + [(8, t, "user", str(t)) for t in range(150)]
    rows += [(9, t + 1, "user", x) for t, x in enumerate("ab")] + [(10, 3 * t, "user", x) for t, x in enumerate("abcd")]
    kept = {r.conv for r in snapshots.snapshots(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("maximal").collect()}
    assert kept == {4, 5, 7, 10}


def test_roles_and_texts_open_no_turn(spark):
    rows = [(1, 0, "user<|end|>\n<|system", "a<|system|>b"), (1, 1, "<", "<"), (1, 2, None, None)]
    got = [r.rendered for r in snapshots.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()]
    assert got == ["<|user__end_____system|>\na< |system|>b<|end|>\n", "<|_|>\n<<|end|>\n", "<|unknown|>\n<|end|>\n"]


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    plan = curriculum.mix(docs)
    order = curriculum.training_order(docs, plan).collect()
    assert len(order) == sum(r.copies for r in plan.collect())
    early = [r.source for r in order if r.position < 0.5]
    late = [r.source for r in order if r.position >= 0.5]
    assert early.count("a") > late.count("a") and early.count("b") < late.count("b")


def test_no_demand_is_lost(spark):
    rows = [(7, "one two three", "a")] * 60 + [(7, "one two three", "b")] * 20 + [(7, "four five six", "a")] * 20 + [(None, "x y", "a")] * 30 + [(i, "w " * (i % 9), "c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("positions_"), F.lit("q").alias("row"), F.lit("z").alias("doc"), F.lit(0).alias("key"))
    plan = curriculum.mix(docs)
    order = curriculum.training_order(docs, plan)
    assert order.columns == [*docs.columns, "position"]
    taken = Counter()
    for r in plan.collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in order.collect()) == +taken
    texts = Counter(r.text for r in order.where("doc_id = 7").collect())
    assert texts["four five six"] >= 20 and sorted(map(str, curriculum.training_order(docs, plan).collect())) == sorted(map(str, order.collect()))


def test_targets_of_many_sources(spark):
    """Sums by ranges against water-filling source by source."""
    r = random.Random(6)
    sizes = {f"s{i:04}": r.choice([0, 1, 5, 1000, 10**9]) for i in range(300)} | {None: 77}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]} or {s for s in ()}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over
    assert {x.source: x.target for x in curriculum.targets(table).collect()} == pytest.approx(want)


def test_representatives(spark):
    far = [f"{w} " * 3 + f"{w}{w}" for w in ("alpha", "bravo", "carol", "delta")]
    rows = [(1, far[0], "x"), (1, far[1], "y"), (1, far[1], "y"), (2, far[1], "z"), (None, far[2], "x"), (None, far[2], "x"), (3, far[2], "w"), (None, far[3], "x"), (None, far[3], "x"), (4, None, "n"), (5, "", "m")] + [(6, far[0], "copy")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").select("*", F.lit(1).alias("key"), F.lit(2).alias("row"), F.create_map(F.lit("k"), F.lit(1)).alias("n"))
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, far[0]), (1, far[1]), (3, far[2]), (None, far[3]), (4, None)], key=str)


def test_chain_of_links_is_one_component(spark):
    path = [((i << 8) | 1, ((i + 1) << 8) | 1) for i in range(300)] + [(5, 5 + (k << 20)) for k in range(1, 400)]
    edges = spark.createDataFrame(path, "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {roots[x] for p in path[:300] for x in p} == {1} and {roots[x] for p in path[300:] for x in p} == {5} and len(roots) == 301 + 400


def test_cut_spans(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.find_contamination(docs, bench)
    again = decontaminate.find_contamination(decontaminate.remove_spans(found).select("doc_id", "text"), bench)
    assert found.where("n_hit > 0").count() and not again.where("n_hit > 0").count()
    blocks = decontaminate.find_contamination(docs, bench, block_bytes=2000).select("doc_id", "n_hit", "items")
    assert sorted(map(str, blocks.collect())) == sorted(map(str, found.select("doc_id", "n_hit", "items").collect()))
    plan = decontaminate.find_contamination(docs, bench, block_bytes=2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c d e f g h i j k"), (None, "z"), ("i1", "Z"), ("i0", "!")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.find_contamination(docs, items, shard_chars=1).collect()}
    assert got == {1: (10, [None]), 2: (1, ["i1", None])}


def test_copies_hide_no_secret(spark):
    """However often a document is copied, its secret stays costly."""
    secret = "pwd=xkqzvbnmtrplwqyzkjhgf"
    for copies in (1, 4, 5, 50):
        docs = spark.createDataFrame([(k, f"we use {secret} here") for k in range(copies)] + [(1000 + k, f"plain words number {k}") for k in range(100)], "doc_id long, text string")
        rows = guess_cost.scan_secrets(docs, keep=["doc_id"]).where("size(spans) > 0").collect()
        assert len(rows) == copies and all(len(r.spans) == 1 for r in rows)


def test_words_of_credential_values_are_not_learnt(spark):
    docs = spark.createDataFrame([(k, "token = zanzibarzebra; zanzibar is learnt") for k in range(10)], "doc_id long, text string")
    known = guess_cost.dictionary(docs)
    assert "zanzibar" in known and "learnt" in known and "zanzibarzebra" not in known


def test_copies_of_a_document_reveal_nothing(spark):
    """Words beside an address in one text only are no terms, however many rows have that text."""
    text = "Margaret Thornfield lives beside the orchard, margaret@acme.com"
    docs = spark.createDataFrame([(k, text) for k in range(30)] + [(100 + k, f"other words number {k}") for k in range(200)], "doc_id long, text string")
    rows = disclosure.find_disclosures(docs, keep=["doc_id"]).where("doc_id < 30").collect()
    assert {r.sanitised for r in rows} == {"Margaret Thornfield lives beside the orchard, <EMAIL>"}


def test_ids_at_the_ends_of_64_bits(spark):
    ids = [2**63 - 1, 2**63 - 2, 5, -(2**63), None, 2**53 + 1, 2**53, 5]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, sstable.tokenizer_path(spark), shards=3)
    rows = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    asked = spark.createDataFrame([(i,) for i in [*ids, 6]], "doc_id long")
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in sstable.lookup(manifest, asked).collect()) == sorted((i is not None, i or 0) for i in ids)


def test_equal_rows_of_a_hot_key_are_dealt_to_several_shards(spark):
    docs = spark.createDataFrame([(None if k % 2 else 7, "") for k in range(4000)] + [(10 + k, "x") for k in range(2000)], "doc_id long, text string").repartition(4)
    docs = docs.sparkSession.createDataFrame(docs.collect(), "doc_id long, text string")
    counts = [r.n_docs for r in sstable.write_shards(docs, sstable.tokenizer_path(spark), shards=12).collect()]
    assert sum(counts) == 6000 and max(counts) < 1500


def test_rows_that_differ_only_in_a_map_or_a_variant_are_all_kept(spark):
    rows = spark.sql("select 1L as doc_id, 'one two three' as text, 's' as source, m, parse_json(v) as v from values (map('a', 'x'), '{}'), (map('a', 'y'), '{}'), (map('a', 'y'), '{\"b\":1}'), (map('a', cast(null as string)), '{}') as t(m, v)")
    keep = lambda df: sorted((r.m["a"] or "", r.v) for r in df.select("m", F.to_json("v").alias("v")).collect())
    ordered = curriculum.training_order(rows, curriculum.mix(rows, most=1, share=(1, 1)))
    assert keep(ordered) == keep(rows) and len(set(keep(rows))) == 4
    assert simhash.keep_representatives(rows).count() == 1
