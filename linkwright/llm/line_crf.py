"""Operator 5, quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Each line with a word has a feature vector (lengths, shares of symbols, capitals, digits, repeated
words and lines); a two-state chain with learned weights and transitions scores label sequences,
Viterbi decoding finds the best one, and the share of the text's line bytes that is content
decides whether the document is kept. The chain is fitted by gradient ascent on the log-likelihood
(forward-backward) over a bounded sample of labelled documents (``max_rows`` of them and
``max_lines`` of each). As labels are of documents, training sequences are spliced: the lines of good
and bad documents, in a fixed random order and as many of each, stand end to end, so the chain sees
both labels in one sequence and where they change.

Scoring is one pass over whole texts in the tasks that scan them; no shuffle. A text is worked
on in memory of a fixed multiple of its own length.

Defined cases: a null or empty text has no words and fails the base rules; without labelled documents
of both kinds a text is judged by the base rules alone; repeated rows are judged alike; a document
labelled both ways counts as bad; of several texts of one sampled id the one of least hash is taken.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, utf8

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
FEATURES = ("bias", "words", "word_length", "symbols", "capitals", "digits", "marks", "stop", "bars", "dup_line", "same_word", "short", "lower_start")


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


CLASSES = (
    table(SYMBOLS),
    table(bytes(range(65, 91))),
    table(bytes(range(97, 123)) + bytes(range(128, 256))),
    table(bytes(range(48, 58))),
    table(b"!?*#$%&"),
    table(b"|"),
)


def repeat_words(words: list[bytes], width: int = 8) -> tuple[int, np.ndarray]:
    """How many words lie in a window that stands twice or more; and whether each word equals the one before."""
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), np.int64, len(words))
    same = np.concatenate(([False], ids[1:] == ids[:-1])) if len(ids) else np.zeros(0, bool)
    n = len(ids) - width + 1
    if n < 2:
        return 0, same
    h = np.zeros(n, np.uint64)
    for d in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[d : d + n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(d + 1)
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    if not equal.any():
        return 0, same
    a, b = order[1:][equal], order[:-1][equal]
    true = np.ones(len(a), bool)
    for d in range(width):
        true &= ids[a + d] == ids[b + d]
    if true.all():
        twice = np.zeros(n, bool)
        twice[a] = twice[b] = True
    else:  # two windows share a hash: count the windows themselves
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True, return_counts=True)
        twice = counts[inverse.ravel()] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum()), same


def line_features(raw: bytes, words: list[bytes], same: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of each line with a word, its bytes, and how many such lines equal an earlier one."""
    lines = raw.split(b"\n")
    n_words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    full = np.flatnonzero(n_words)
    used = [lines[i] for i in full]
    counts = Counter(used)
    n_dup = len(used) - len(counts)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[full]
    ends = ends[full]
    data = np.frombuffer(raw, np.uint8)
    sums = []
    for c in CLASSES:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(c[data], out=total[1:], dtype=np.int32)
        sums.append((total[ends] - total[starts]).astype(np.float64))
    symbols, capitals, small, digits, marks, bars = sums
    length, n = (ends - starts).astype(np.float64), n_words[full].astype(np.float64)
    word_ends = np.cumsum(n_words)[full]
    again = np.concatenate(([0], np.cumsum(same)))
    same_word = again[word_ends] - again[word_ends - n_words[full]]
    stop = np.fromiter((x.rstrip(SPACE)[-1:] in b".!?:;" for x in used), np.float64, len(used))
    lower = np.fromiter((x.lstrip(SPACE)[:1].islower() for x in used), np.float64, len(used))
    x = np.stack(
        (
            np.ones(len(used)),
            np.log1p(n) / 4,
            np.minimum(length / n, 40) / 10,
            symbols / length,
            capitals / np.maximum(capitals + small, 1),
            digits / length,
            np.minimum(marks / n, 3),
            stop,
            np.minimum(bars / n, 2),
            np.fromiter((counts[u] > 1 for u in used), np.float64, len(used)),
            same_word / n,
            (n <= 3).astype(np.float64),
            lower,
        ),
        axis=1,
    )
    return x, length, n_dup


@dataclass(frozen=True)
class Chain:
    """Weights for content against boilerplate, and transition scores [from][to], 1 being content."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence, by Viterbi; ties go to content."""
        emit = (x @ np.array(self.weights)).tolist()
        (t00, t01), (t10, t11) = self.moves
        back: list[tuple[int, int]] = []
        s0, s1 = 0.0, emit[0]
        for e in emit[1:]:
            a, b = s0 + t00, s1 + t10
            c, d = s0 + t01, s1 + t11
            back.append((int(b >= a), int(d >= c)))
            s0, s1 = max(a, b), max(c, d) + e
        state = int(s1 >= s0)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return np.array(out[::-1], bool)


def spliced(documents: list[tuple[np.ndarray, int]], joined: int = 3, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of sequences of so many documents' lines each; both labels are drawn alike often."""
    rng = np.random.default_rng(seed)
    of = {y: [x for x, z in documents if z == y and len(x)] for y in (0, 1)}
    if not of[0] or not of[1]:
        return []
    n = max(map(len, of.values()))
    drawn = [(x, y) for y, xs in of.items() for x in (xs[k % len(xs)] for k in range(n))]
    drawn = [drawn[k] for k in rng.permutation(len(drawn))]
    parts = [drawn[i : i + joined] for i in range(0, len(drawn), joined)]
    return [(np.concatenate([x for x, _ in p]), np.concatenate([np.full(len(x), y) for x, y in p])) for p in parts]


def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 150, ridge: float = 0.5) -> Chain | None:
    """Maximum likelihood with forward-backward on spliced documents; None without lines of both labels."""
    parts = sorted(spliced(documents), key=lambda p: len(p[0]))
    if not parts:
        return None
    k = len(FEATURES)
    groups = []
    for i in range(0, len(parts), 256):  # of like length, padded
        some = parts[i : i + 256]
        width = max(len(x) for x, _ in some)
        xs, mask, ys = np.zeros((len(some), width, k)), np.zeros((len(some), width)), np.zeros((len(some), width), np.int64)
        for j, (x, y) in enumerate(some):
            xs[j, : len(x)], mask[j, : len(x)], ys[j, : len(x)] = x, 1, y
        seen = np.zeros((2, 2))
        np.add.at(seen, (ys[:, :-1], ys[:, 1:]), mask[:, 1:])
        groups.append((xs, mask, np.einsum("dl,dlk->k", mask * ys, xs), seen))
    lines = sum(mask.sum() for _, mask, _, _ in groups)
    w, t = np.zeros(k), np.zeros((2, 2))
    m1, m2 = np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, rounds + 1):
        gw, gt = -ridge * w, -ridge * t
        for xs, mask, felt, seen in groups:
            p1, pair = marginals(xs @ w, mask, t)
            gw = gw + felt - np.einsum("dl,dlk->k", mask * p1, xs)
            gt = gt + seen - pair.sum(axis=0)
        g = np.concatenate((gw, gt.ravel())) / lines
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, t = w + move[:k], t + move[k:].reshape(2, 2)
    return Chain(tuple(map(float, w)), ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1]))))


def marginals(emit: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each line, and expected moves of each document, by forward-backward in scaled form."""
    d, n = emit.shape
    e = np.stack((np.ones_like(emit), np.exp(np.clip(emit, -30, 30))), axis=2)
    e /= e.sum(axis=2, keepdims=True)
    m = np.exp(t)
    alpha, beta = np.zeros((d, n, 2)), np.ones((d, n, 2))
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, n):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = np.where(mask[:, i, None] > 0, a, alpha[:, i - 1])
    pair = np.zeros((d, 2, 2))
    for i in range(n - 2, -1, -1):
        b = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        both = alpha[:, i, :, None] * m[None] * (e[:, i + 1] * beta[:, i + 1])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        on = mask[:, i + 1, None] > 0
        pair += np.where(on[:, :, None], both, 0)
        beta[:, i] = np.where(on, b / b.sum(axis=1, keepdims=True), 1.0)
    p = alpha * beta
    return p[..., 1] / p.sum(axis=2), pair


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_lines: int = 64, key: str = "doc_id", text: str = "text") -> list[tuple[np.ndarray, int]]:
    """Features of the first lines, and label, of labelled documents: half of each label, by hash of the id."""
    known = labels.where("quality is not null").groupBy(F.col(key).alias("key")).agg(F.min("quality").cast("int").alias("quality")).where("key is not null")
    half = max_rows // 2
    order = F.xxhash64("key")
    chosen = known.where("quality = 0").orderBy(order, "key").limit(half).union(known.where("quality = 1").orderBy(order, "key").limit(max_rows - half))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "key")

    def make():
        def fn(texts: list) -> dict:
            out = []
            for t in texts:
                raw = utf8(t or "")
                words = raw.split()
                x = line_features(raw, words, repeat_words(words)[1])[0] if words else np.zeros((0, len(FEATURES)))
                out.append(x[:max_lines].astype("<f4").tobytes())
            return {"lines": out}

        return fn

    found = map_texts(rows, make, "lines binary", "text", ["key", "quality", "h"])
    one = found.groupBy("key").agg(F.min("quality").alias("quality"), F.min(F.struct("h", "lines")).alias("x")).select("key", "quality", "x.lines").collect()
    return [(np.frombuffer(r.lines, "<f4").reshape(-1, len(FEATURES)).astype(float), r.quality) for r in sorted(one, key=lambda r: r.key) if r.lines]


def apply_rules(docs: DataFrame, chain: Chain | None, least_share: float = 0.5, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and RULES: base counts, the base rules' verdict, the share of content, and the verdict."""

    def judge(t: str | None) -> tuple:
        raw = utf8(t or "")
        words = raw.split()
        n = len(words)
        word_chars = len(t or "") - (len(raw) - len(raw.translate(None, SPACE)))
        n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        if not n:
            return 0, word_chars, n_symbols, 0, 0, True, 0.0, False
        repeated, same = repeat_words(words)
        x, length, n_dup = line_features(raw, words, same)
        failed = n < 20 or 100 * repeated > 30 * n
        share = 1.0 if chain is None else round(float(length[chain.decode(x)].sum() / length.sum()), 6)
        return n, word_chars, n_symbols, n_dup, repeated, failed, share, not failed and share >= least_share

    names = [c.split()[0] for c in RULES.split(", ")]

    def make():
        return lambda texts: dict(zip(names, map(list, zip(*map(judge, texts), strict=True)), strict=True))

    return map_texts(docs, make, RULES, text, keep)
