"""Operator 1, benchmark decontamination: an FM-index per training shard.

Documents are read in shards of bounded size inside the tasks. Each shard's words become an
FM-index: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix,
and sampled suffix positions. Benchmark windows are searched backwards through the wavelet
ranks, all of them at once, occurrences are located from the samples, and overlapping ones are
merged to the spans to remove.

The index's alphabet is the benchmark's vocabulary. A word outside it can stand in no window,
so it ends a run of the shard's text, and a run shorter than the shortest window holds no
occurrence; both are left out of the suffix array, which changes no result.

No shuffle: documents stay in their partition, and a shard is a stretch of one. The benchmark is
written once to the shared folder; tasks read it from there in blocks of at most ``block_bytes``
of text, and search every block in the one index of their shard. Neither the driver nor a task
holds more of the benchmark than a block; the words of the shard's texts are held as codes.

Defined cases: a null or empty text has no words and no hits; a null or empty item text has no
window; items without an id are one nameless item, null in ``items`` and last there; repeated
items and repeated documents are each answered alike; an item of fewer words than a window is
one window; input columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.shared import Spool
from .common import LOWER_STR, WORD_RE, item_words, merge_spans, small_batches

#: Result columns: words of the text, words hit, spans to remove as code points, items with an occurring window.
HITS = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"


class FMIndex:
    """Over an int array in which 0 ends each run and other codes are the alphabet.

    Runs end in distinct terminators, ordered by place, so the suffix order is total and no
    comparison goes beyond a run.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        self.n = n = len(text)
        sa = suffix_array(text, sigma)
        bwt = text[sa - 1]  # the last terminator precedes position 0
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))  # rows of smaller symbols
        starts = np.concatenate(([True], text[:-1] == 0))
        marked = ((np.arange(n) % sample == 0) | starts)[sa]
        self.marked, self.samples = marked, sa[marked]
        self.mark_rank = np.cumsum(marked) - 1
        self.levels: list[tuple[int, np.ndarray, int]] = []  # shift, ones before each row, number of zeros
        rows = bwt
        for shift in range(max(int(sigma).bit_length(), 1) - 1, -1, -1):
            bit = (rows >> shift) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, n - int(ones[-1])))
            rows = np.concatenate((rows[bit == 0], rows[bit == 1]))
        self.base = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            before = ones[rows]
            rows = np.where((symbols >> shift) & 1, zeros + before, rows - before)
        return rows

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before its row."""
        return self._down(symbols, rows) - self.base[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of patterns, one a row, by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            lo[alive] = self.first[c] + self.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = lo >= hi
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            here = self.marked[rows]
            out[left[here]] = self.samples[self.mark_rank[rows[here]]] + steps
            left, rows, steps = left[~here], rows[~here], steps + 1
            symbols, down = np.zeros(len(rows), np.int64), rows
            for shift, ones, zeros in self.levels:
                before = ones[down]
                bit = ones[down + 1] - before
                symbols |= bit.astype(np.int64) << shift
                down = np.where(bit, zeros + before, down - before)
            rows = self.first[symbols] + down - self.base[symbols]
        return out


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """By prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    end = text == 0
    n_ends = int(end.sum())
    key = np.where(end, np.cumsum(end) - 1, n_ends + text.astype(np.int64))
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[sa] = run_starts(key[sa])
    open_ = tied(rank[sa], sa)
    k = 1
    while len(open_):
        second = rank[np.minimum(open_ + k, n - 1)]  # a tie never reaches past a terminator
        order = np.lexsort((second, rank[open_]))
        pos, r1, r2 = open_[order], rank[open_][order], second[order]
        offset = np.arange(len(pos)) - run_starts(r1)
        sa[r1 + offset] = pos
        new = np.concatenate(([True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])))
        rank[pos] = (r1 + offset)[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        open_ = tied(rank[pos], pos)
        k *= 2
    return sa


def run_starts(values: np.ndarray) -> np.ndarray:
    """For each place of a grouped array, where its run of equal values begins."""
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def tied(ranks: np.ndarray, pos: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    return pos[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(ranks) else pos


class Windows:
    """The distinct windows of benchmark items as word codes, by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.codes: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, text in items:
            words = [self.codes.setdefault(w, len(self.codes)) for w in item_words(text)]
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.by_length = [(size, np.array(list(w), np.int64), list(w.values())) for size, w in sorted(found.items())]
        self.shortest = self.by_length[0][0] if found else 0


class Shard:
    """Texts under one FM-index, whose alphabet are the words that some block of the benchmark has too."""

    def __init__(self, texts: list[str | None], blocks: Iterator[Windows]):
        words = [item_words(t) for t in texts]
        self.n_words = [len(w) for w in words]
        distinct, common = set().union(*words), set()
        self.shortest = 0
        for block in blocks:
            common |= distinct & block.codes.keys()
            if block.shortest:
                self.shortest = min(self.shortest or block.shortest, block.shortest)
        self.codes = {w: i for i, w in enumerate(sorted(common), 1)}
        pieces: list[np.ndarray] = []
        self.doc_of, self.word_of = [], []
        for d, here in enumerate(words):
            if not here or not self.codes:
                continue
            codes = np.fromiter(map(self.codes.get, here, repeat(0)), np.int32, len(here))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], codes > 0, [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= self.shortest:
                    pieces += [codes[a:b], np.zeros(1, np.int32)]
                    self.doc_of.append(d)
                    self.word_of.append(a)
        self.starts = np.cumsum([0] + [len(p) + 1 for p in pieces[::2]])[:-1]
        self.index = FMIndex(np.concatenate(pieces), len(self.codes)) if pieces else None

    def occurrences(self, windows: Windows) -> Iterator[tuple[int, int, int, set[str | None]]]:
        """document, first word, words, and items, of each place where a window stands."""
        if self.index is None:
            return
        here = np.fromiter(map(self.codes.get, windows.codes, repeat(0)), np.int64, len(windows.codes))
        for size, patterns, owners in windows.by_length:
            coded = here[patterns]
            able = np.flatnonzero((coded > 0).all(axis=1))
            lo, hi = self.index.search(coded[able])
            some = np.flatnonzero(hi > lo)
            count = hi[some] - lo[some]
            which = np.repeat(able[some], count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[some], count)
            at = self.index.locate(rows)
            run = np.searchsorted(self.starts, at, "right") - 1
            for w, r, p in zip(which.tolist(), run.tolist(), at.tolist(), strict=True):
                yield self.doc_of[r], self.word_of[r] + p - int(self.starts[r]), size, owners[w]


def named(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shard_chars: int = 16 << 20,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """docs with the columns of HITS: words, words hit, spans to remove and the items met.

    ``shard_chars`` bounds the text of one index, ``block_bytes`` the benchmark text that a task
    holds at once. A benchmark of several blocks is read twice for each shard: for its words,
    which make the alphabet, and for its windows.
    """
    small_batches(docs.sparkSession)
    fields = T.StructType.fromDDL(HITS).fields
    names = {f.name for f in fields}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names))
    items = Spool(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null"), block_bytes)
    schema = T.StructType([*docs.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    at, columns = docs.columns.index(text), len(docs.columns)

    def blocks() -> Iterator[Windows]:
        return items.blocks(lambda t: Windows(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)), width))

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for b in held for x in b.column(at).to_pylist()]
        shard = Shard(texts, blocks())
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items_of: dict[int, set[str | None]] = defaultdict(set)
        for block in blocks():
            for d, first, size, owners in shard.occurrences(block):
                places[d].append((first, first + size))
                items_of[d] |= owners
        begin = 0
        for batch in held:
            rows = range(begin, begin + batch.num_rows)
            begin += batch.num_rows
            words = [merge_spans(places.get(d, [])) for d in rows]
            new = [
                [shard.n_words[d] for d in rows],
                [sum(b - a for a, b in w) for w in words],
                [[{"start": a, "end": b} for a, b in word_spans(texts[d], w)] for d, w in zip(rows, words, strict=True)],
                [named(items_of.get(d, set())) for d in rows],
            ]
            arrays = [batch.column(i) for i in range(columns)] + [pa.array(v, arrow.field(f.name).type) for v, f in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(at).nbytes
            if size >= shard_chars:
                yield from finish(held)
                held, size = [], 0
        if held:
            yield from finish(held)

    return docs.mapInArrow(run, schema)


def word_spans(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    if not spans:
        return []
    places = [m.span() for m in WORD_RE.finditer(text.translate(LOWER_STR))]
    return merge_spans([(places[a][0], places[b - 1][1]) for a, b in spans])


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with each span of the text replaced by one space, where it has any; no other text changes."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(" ")).alias("out"),
            s["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text)))
