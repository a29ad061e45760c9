"""Operator 2, SimHash near-dedup: a byte-position inverted index with count filtering.

Two fingerprints of 8 bytes that differ in at most ``bits`` bits agree in at least 8 - bits
positional bytes, the guaranteed number of matches. Postings of the index are keyed by
(positions, bytes). A posting of one byte would hold 1/256 of all fingerprints, and tallying all
pairs in it would grow with the square of the corpus; the postings here are therefore
intersections of three of them, for a family of position triples such that any four positions
contain one whole triple. So every pair with four shared bytes meets in some posting. There its
shared positional bytes are tallied over all eight positions, pairs under the guaranteed number
are dropped, and the rest are verified by their differing bits.

Equal fingerprints are one node, so copies never make pairs. Within a posting only a spanning
forest of the links is emitted, at most one link a member; connected components, which are what
the result needs, lose nothing by it. Components come from min-label contraction of the links
(large star, small star) with checkpoints; nothing is collected. A fingerprint, a component or a
star's centre with more than 1 in 10,000 of the rows meets them by broadcast, of which there can be
fewer than 10,000, the others by a shuffle.

A posting with more members than ``posting_rows``, estimated from a sample of the fingerprints,
is split in blocks, and each pair of blocks is its own group: the work spreads over tasks and no
pair is lost. The estimate only decides the split, never the result.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; repeated rows return one row each with the same component;
a null doc_id gets its component's smallest id, null if the component has none. Of a group one row
is kept, also where ids are missing, repeated or shared by different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, map_texts, row_hash, utf8, with_hot_keys

BYTES = 8


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of 64 bits over word shingles, as a signed integer."""
    words = utf8(text).translate(LOWER_BYTES).split() if text else []
    if not words:
        return 0
    buf = b" ".join(words)
    size = min(width, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    digest = xxhash.xxh64_intdigest
    view = memoryview(buf)
    hashes = [digest(view[a:b], 42) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    step = 1 << 16
    for i in range(0, len(hashes), step):
        part = np.array(hashes[i : i + step], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and fp, a signed long."""

    def make():
        return lambda texts: {"fp": [fingerprint(t, width) for t in texts]}

    return map_texts(docs, make, "fp long", text, keep)


def covering_triples(matches: int = BYTES // 2) -> list[tuple[int, ...]]:
    """Position sets such that any ``matches`` of the 8 positions contain one whole set.

    For four matches: three cyclic classes of positions, and the triples within a class or with
    two in a class and one in the next (20 of 56). Otherwise all sets of min(matches, 3).
    """
    if matches != 4:
        return list(combinations(range(BYTES), min(matches, 3)))
    kind = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t: tuple[int, ...]) -> bool:
        n = [sum(kind[p] == k for p in t) for k in range(3)]
        return 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3))

    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def links(fps: DataFrame, bits: int = 4, posting_rows: int = 20_000, sample_rate: int = 64) -> DataFrame:
    """A spanning set of the links between distinct fingerprints: columns a > b, distinct.

    ``fps`` has the distinct fingerprints in column fp.
    """
    triples = covering_triples(BYTES - bits)
    masks = [sum(0xFF << (8 * (BYTES - 1 - p)) for p in t) for t in triples]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)))
    postings = fps.select("fp", F.explode(keys).alias("key")).select("fp", F.col("key.k").alias("k"), F.col("key.v").alias("v"))
    sampled = F.pmod(F.xxhash64("fp"), F.lit(sample_rate)) == 0
    hot = postings.where(sampled).groupBy("k", "v").count().where(F.col("count") * sample_rate > posting_rows)
    hot = checkpointed(hot.select("k", "v", F.ceil(F.col("count") * sample_rate / posting_rows).cast("int").alias("blocks")))
    if hot.isEmpty():
        blocked = postings.withColumn("block", F.lit(0)).withColumn("other", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        blocked = (
            postings.join(hot, ["k", "v"], "left")
            .withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(own))
            .withColumn("i", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
            .select("fp", "k", "v", F.least("own", "i").alias("block"), F.greatest("own", "i").alias("other"))
        )
    dealt = blocked.repartition("k", "v", "block", "other").sortWithinPartitions("k", "v", "block", "other")
    found = dealt.select("k", "v", "block", "other", "fp").mapInArrow(lambda it: posting_links(it, bits), "a long, b long")
    return found.distinct()


def posting_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The links of each posting, from rows sorted by posting; a posting may span batches."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:4]:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        rest = [c[last:] for c in columns]
        yield from as_links(run_links(columns[4][:last], new[:last], bits))
    if rest is not None:
        yield from as_links(run_links(rest[4], np.zeros(len(rest[4]), bool), bits))


def as_links(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(pairs):
        pairs.sort(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["a", "b"])


def matching(x: np.ndarray, bits: int) -> np.ndarray:
    """Which differences keep the guaranteed number of positional bytes, and stay within the bits."""
    tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = tally >= BYTES - bits
    out[out] = np.bitwise_count(x[out].view(np.uint64)) <= bits
    return out


def run_links(fp: np.ndarray, new: np.ndarray, bits: int, small: int = 8) -> np.ndarray:
    """Links within runs: all of a small run's, a spanning forest of a larger one's."""
    if len(fp) < 2:
        return np.zeros((0, 2), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], new[1:])))
    sizes = np.diff(np.concatenate((starts, [len(fp)])))
    out = []
    size_of = np.repeat(sizes, sizes)
    place = np.arange(len(fp)) - np.repeat(starts, sizes)
    for step in range(1, min(small, int(sizes.max(initial=1)))):
        at = np.flatnonzero((size_of <= small) & (place + step < size_of))
        at = at[matching(fp[at] ^ fp[at + step], bits)]
        out.append(np.stack((fp[at], fp[at + step]), axis=1))
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        out.append(forest(fp[s : s + n], bits))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def forest(members: np.ndarray, bits: int) -> np.ndarray:
    """Breadth-first search over members; each member is compared with those not yet reached."""
    left, out = members, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = matching(left ^ node, bits)
            if near.any():
                reached = left[near]
                out.append(np.stack((np.full(len(reached), node), reached), axis=1))
                queue.extend(reached)
                left = left[~near]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for each node of an edge (a, b).

    Large-star and small-star steps in turn until the edges are stars, which takes rounds in the
    order of the square of the logarithm of the nodes; an error after ``max_rounds``. Each step takes a
    node's smallest neighbour by a grouped minimum (map-side combined) and joins it back, so a
    node with very many neighbours is never gathered.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_")).select("a", F.least("a", "m").alias("m"), "n_")
        far = with_hot_keys(both, low, "a", 2 * edges.count()).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = far.union(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b")))
        after = checkpointed(small.where("a <> b").distinct())
        # Stars: no node that has a root is itself a root.
        done = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
        several = after.groupBy("a").count().where("count > 1").isEmpty()
        edges = after
        if done and several:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def grouped(docs: DataFrame, bits: int, width: int, text: str, key: str) -> DataFrame:
    """key, row (a hash of all columns), fp, root (the component), component_id, of each document."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), row_hash(docs).alias("row"))
    marked = checkpointed(fingerprints(slim, width, "text", ["key", "row"]))
    smallest = checkpointed(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n_")))
    roots = components(links(smallest.select("fp"), bits))
    label = smallest.join(roots, smallest.fp == roots.node, "left").select("fp", "least", "n_", F.coalesce("root", "fp").alias("root"))
    label = checkpointed(label)
    ids = label.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_"))
    named = with_hot_keys(label.withColumnRenamed("n_", "copies"), ids, "root", label.count()).withColumnRenamed("copies", "n_")
    return with_hot_keys(marked, checkpointed(named.select("fp", "root", "component_id", "n_")), "fp", marked.count())


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp, component_id (the smallest key reachable over links, itself included)."""
    return grouped(docs, bits, width, text, key).select(F.col("key").alias(key), "fp", "component_id")


def keep_representatives(docs: DataFrame, bits: int = 4, width: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group: the one with the smallest key, rows without a key last; among
    several of that key, one chosen by a hash of its whole row, and one of rows alike in all columns."""
    found = grouped(docs, bits, width, text, key)
    alike = found.groupBy("root", "key", "row").agg(F.count("*").alias("n"))
    chosen = alike.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "row", "n")).alias("c"))
    chosen = checkpointed(chosen.select(F.col("c.key").alias("chosen"), F.col("c.row").alias("chosen_row"), F.col("c.n").alias("n")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), row_hash(docs).alias("row"))

    def kept(which: DataFrame) -> DataFrame:
        return rows.join(which, (rows["row"] == which["chosen_row"]) & rows["key"].eqNullSafe(which["chosen"]), "left_semi")

    out = kept(chosen.where("n = 1")).select("doc.*")
    several = chosen.where("n > 1")
    if several.isEmpty():
        return out
    return out.unionByName(kept(several).groupBy("key", "row").agg(F.first("doc").alias("doc")).select("doc.*"))
