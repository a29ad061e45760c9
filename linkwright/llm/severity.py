"""Operator 10, toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds; x are
sparse text features, the presence of words that tell toxic from other labelled texts. The model
is fitted on a bounded sample of labelled documents (``max_rows``, chosen by hash of the id) and
vocabulary (``max_words``, those that tell most); the tasks read the sampled texts and count their
words, and the driver gets the vocabulary and each text's numbers of its words. Scoring reads every
whole text once, in the tasks that scan it, without a shuffle.

Labels say toxic or not, so grades beyond that are derived from the same labels: 1 for a toxic text
of at most one marked word (whose log-odds for toxic texts pass ``mark``), 2 for two or three, 3 for
more. They order toxic texts by how much of the marked words they hold and are no finer truth.

Defined cases: a null or empty text has no features and severity near 0; without labelled toxic
texts, or others, every severity is 0; repeated rows score alike; null labels are not used; a document
labelled both ways counts as toxic; of several texts of one sampled id the one of least hash is taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, item_words, map_texts

GRADES = 3
SCORES = "severity double, grade int, toxic boolean"


@dataclass(frozen=True)
class Model:
    """Weights by word, and the ordered thresholds of grades 1 to GRADES."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (40.0,) * GRADES

    def above(self, words: set[bytes]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        z = sum(sorted(self.weights[w] for w in words if w in self.weights))
        return 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -40, 40)))


@dataclass(frozen=True)
class Sample:
    """The vocabulary with its log-odds, and of each sampled text the numbers of its words and whether it is toxic."""

    vocab: list[bytes]
    odds: list[float]
    texts: list[list[int]]
    toxic: list[bool]


def labelled_words(docs: DataFrame, labels: DataFrame, max_rows: int, key: str, text: str) -> DataFrame:
    """key, toxic, words: the distinct words of at most so many labelled documents, toxic ones first up to half."""
    known = labels.where("toxic is not null").groupBy(F.col(key).alias("key")).agg(F.max("toxic").alias("toxic")).where("key is not null")
    order = F.xxhash64("key")
    half = max_rows // 2
    chosen = known.where("toxic = 1").orderBy(order, "key").limit(half).union(known.where("toxic = 0").orderBy(order, "key").limit(max_rows - half))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "key")

    def make():
        return lambda batch: {"words": [sorted(set(item_words(t))) for t in batch]}

    bags = map_texts(texts, make, "words array<binary>", "text", ["key", "toxic", "h"])
    return bags.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min(F.struct("h", "words")).alias("x")).select("key", "toxic", "x.words")


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_words: int = 20_000, min_docs: int = 4, key: str = "doc_id", text: str = "text") -> Sample:
    """A word is taken if it stands in ``min_docs`` texts at least and its log-odds, less two standard
    errors, pass 0.5: in a few texts it may stand by chance."""
    bags = checkpointed(labelled_words(docs, labels, max_rows, key, text))
    total = bags.agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") != 1).alias("n0")).first()
    if not total.n1 or not total.n0:
        return Sample([], [], [], [])
    words = bags.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("c1"), F.count_if(F.col("toxic") != 1).alias("c0"))
    log_odds = lambda c, n: F.log((F.col(c) + 0.5) / (n - F.col(c) + 0.5))
    words = words.where(F.col("c1") + F.col("c0") >= min_docs).withColumn("odds", log_odds("c1", total.n1) - log_odds("c0", total.n0))
    telling = words.where(F.col("odds") - 2 * F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5)) > 0.5)
    vocab = sorted((bytes(r.w), r.odds) for r in telling.orderBy(F.col("odds").desc(), "w").limit(max_words).collect())
    numbers = docs.sparkSession.createDataFrame([(bytearray(w), i) for i, (w, _) in enumerate(vocab)], "w binary, i int")
    held = bags.select("key", F.explode("words").alias("w")).join(F.broadcast(numbers), "w").groupBy("key").agg(F.sort_array(F.collect_list("i")).alias("held"))
    rows = bags.select("key", "toxic").join(held, "key", "left").collect()
    rows.sort(key=lambda r: r.key)
    return Sample([w for w, _ in vocab], [o for _, o in vocab], [r.held or [] for r in rows], [r.toxic == 1 for r in rows])


def fit(rows: Sample, mark: float = 2.5, rounds: int = 400, ridge: float = 0.02) -> Model:
    """Gradient ascent on the ordinal log-likelihood; deterministic."""
    if not rows.vocab:
        return Model()
    marked = np.array(rows.odds) >= mark
    r = np.repeat(np.arange(len(rows.texts)), [len(t) for t in rows.texts])
    c = np.array([i for t in rows.texts for i in t], np.int64)
    count = np.bincount(r, marked[c], len(rows.texts))
    grade = np.where(rows.toxic, np.where(count <= 1, 1, np.where(count <= 3, 2, 3)), 0)
    return ordinal(r, c, grade, rows.vocab, rounds, ridge)


def gradient(w: np.ndarray, theta: float, steps: np.ndarray, r: np.ndarray, c: np.ndarray, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised log-likelihood of the grades, and its gradient by weights, first threshold and steps.

    Thresholds are a first one and steps of exp(steps), so they stay in order.
    """
    z = np.bincount(r, w[c], len(grade))
    cut = theta + np.concatenate(([0], np.cumsum(np.exp(steps))))
    p = 1 / (1 + np.exp(-np.clip(z[None] - cut[:, None], -40, 40)))
    s = p * (1 - p)
    at_least, above, rows = np.maximum(grade - 1, 0), np.minimum(grade, GRADES - 1), np.arange(len(grade))
    upper = np.where(grade > 0, p[at_least, rows], 1.0)  # P(grade >= g)
    lower = np.where(grade < GRADES, p[above, rows], 0.0)  # P(grade > g)
    cell = np.maximum(upper - lower, 1e-9)
    d_upper = np.where(grade > 0, s[at_least, rows], 0.0) / cell
    d_lower = np.where(grade < GRADES, s[above, rows], 0.0) / cell
    g_cut = np.zeros(GRADES)
    np.add.at(g_cut, at_least, -d_upper)
    np.add.at(g_cut, above, d_lower)
    g_steps = np.array([g_cut[k + 1 :].sum() for k in range(GRADES - 1)]) * np.exp(steps)
    g_w = np.bincount(c, (d_upper - d_lower)[r], len(w)) - ridge * w
    return float(np.log(cell).sum() - ridge * (w @ w) / 2), np.concatenate((g_w, [g_cut.sum()], g_steps))


def ordinal(r: np.ndarray, c: np.ndarray, grade: np.ndarray, vocab: list[bytes], rounds: int, ridge: float) -> Model:
    """Fit weights and thresholds; (r, c) are the texts and words that meet."""
    w, theta, steps = np.zeros(len(vocab)), 3.0, np.zeros(GRADES - 1)
    m = [np.zeros(len(vocab) + GRADES), np.zeros(len(vocab) + GRADES)]
    for t in range(1, rounds + 1):
        g = gradient(w, theta, steps, r, c, grade, ridge)[1]
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        step = 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
        w, theta, steps = w + step[: len(vocab)], theta + step[len(vocab)], np.clip(steps + step[len(vocab) + 1 :], -5, 5)
    cut = theta + np.concatenate(([0], np.cumsum(np.exp(steps))))
    return Model({v: float(x) for v, x in zip(vocab, w, strict=True) if abs(x) > 1e-3}, tuple(map(float, cut)))


def score(docs: DataFrame, model: Model, reject: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and SCORES: expected severity, likeliest grade, and whether P(grade > 0) passes ``reject``."""

    def make():
        def fn(texts: list) -> dict:
            out: dict[str, list] = {"severity": [], "grade": [], "toxic": []}
            for t in texts:
                p = model.above(set(item_words(t)) & model.weights.keys())
                cells = -np.diff(np.concatenate(([1.0], p, [0.0])))
                out["severity"].append(float(round(p.sum(), 6)))
                out["grade"].append(int(cells.argmax()))
                out["toxic"].append(bool(p[0] >= reject))
            return out

        return fn

    return map_texts(docs, make, SCORES, text, keep)
