"""Operator 4, token ids in sorted-string-table shards.

Documents are encoded in the tasks that read them and dealt to shards by ranges of their key;
only the ids move, compressed. Each shard is one file, written in key order:

    block ...   entries of: varint shared key bytes, varint own key bytes, varint value bytes,
                own key bytes, value; then crc32 of the entries (4 bytes)
    index       entries of: varint key bytes, last key of the block, varint offset, varint length
    Bloom       k (1 byte), then the bits
    footer      48 bytes: offset and length of index and Bloom, documents, ids, id width, magic

Integers outside varints are little-endian. A key is 0x00 for null, or 0x01 and the id as 8
big-endian bytes with the sign bit turned, so byte order is id order. A value is the crc32 of the
document's ids as unsigned 32-bit integers, then the ids at the footer's width, compressed.
A reader finds a key by the Bloom filter, binary search in the sparse index, and a scan of one
block; a full read streams the blocks.

A shard is written under a name of its own attempt and the manifest lists only finished files, so
a lost executor's half-written shard is never read. The manifest is checkpointed: its files are
written once. Files go through pyarrow's file systems to a shared folder.

A key that fills several ranges by itself, or no key at all, is dealt to as many shards by the number of its row
in its partition, equal rows too, so no task writes all of its documents. For that the documents should come
from a table or another source that gives a partition's rows in one order.

Defined cases: a null or empty text gives the end id alone; null keys come first; repeated keys
are kept, each as a document, next to each other, in the order of their values' bytes within a
shard; ids may be any of 64 bits; an empty table makes no shard.
"""

from __future__ import annotations

import bisect
import io
import json
import os
import re
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import checkpointed, new_folder, open_fs
from .common import map_texts

MAGIC = b"SSTB0001"
FOOTER = struct.Struct("<QIQIQQ")  # index offset, length; Bloom offset, length; documents, ids
TAIL = struct.Struct("<B7s8s")  # width, padding, magic
FOOTER_BYTES = FOOTER.size + TAIL.size
#: Sampled keys a shard, of which the driver makes the cuts.
SAMPLE = 64
SHARD = "place int, part int, path string, first_key binary, last_key binary, n_docs long, n_ids long, n_bytes long"
#: Kinds of bytes: white space, ASCII letters and digits, the rest of ASCII; then the two bytes of a letter between
#: U+00C0 and U+023F or U+0400 and U+047F. Other letters are not told; a cut left out costs only time.
WHITE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
WORD = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
OTHER = (np.arange(256) < 128) & ~WHITE & ~WORD
LEAD = np.isin(np.arange(256), [*range(0xC3, 0xC9), 0xD0, 0xD1])
TRAIL = (np.arange(256) >> 6 == 2) & ~np.isin(np.arange(256), [0x97, 0xB7])
#: Bytes of texts that are cut in pieces at a time.
GROUP_BYTES = 1 << 20
#: Code points that some rule calls space beside those six; a text with any is encoded whole.
ODD_RANGES = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
ODD_SPACE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_RANGES) + "]")


class Encoder:
    """Byte-level BPE by the tokenizers library, with a bounded memory of the ids of pieces.

    Texts are cut where the byte-level pre-tokenizer always cuts, so encoding by pieces equals
    encoding the whole text, and the library is asked once for each distinct piece. With a tokenizer
    of another kind, and for a text with an added token or a piece of more than ``longest`` bytes,
    the whole text is encoded. At most ``max_chunks`` pieces and ``max_chars`` of their bytes are remembered.
    """

    def __init__(self, path: str, max_chunks: int = 1_000_000, max_chars: int = 32 << 20, longest: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_chunks, self.max_chars, self.longest = max_chunks, max_chars, longest
        self.cuts_at_space = cuts_at_space(self.tokenizer.to_str())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # a byte-level token has a character a byte
        self.n_bytes[list(vocab.values())] = list(map(len, vocab))
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if len(self.n_bytes) <= 1 << 16 else np.uint32), 0
        self.bounds = np.zeros(1 << 12, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, pieces: list[bytes]) -> None:
        # One call for many pieces that begin with a space and no other: put end to end they are cut there again.
        spaced = [p for p in pieces if p[0] == 32 and p[1:2].strip()]
        rest = [p for p in pieces if p[0] != 32 or not p[1:2].strip()]
        for i in range(0, len(spaced), 1000):
            part = spaced[i : i + 1000]
            ids = np.array(self.whole(b"".join(part).decode()), np.uint32)
            ends, stops = np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, part)))
            last = np.searchsorted(ends, stops)
            if last[-1] == len(ids) - 1 and (ends[last] == stops).all():
                self.keep(part, ids, np.diff(last, prepend=-1))
            else:  # some bytes have no token
                rest += part
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.keep(rest, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def keep(self, pieces: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Add pieces, with their ids one after another."""
        n = len(self.at)
        self.ids, self.bounds = grown(self.ids, self.used + len(flat)), grown(self.bounds, n + len(pieces) + 1)
        self.ids[self.used : self.used + len(flat)] = flat
        self.bounds[n + 1 : n + 1 + len(pieces)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.at.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        out = [np.zeros(0, np.uint32)] * len(texts)
        places: list[int] = []
        group: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuts_at_space or ODD_SPACE.search(text) or any(t in text for t in self.added):
                out[i] = np.array(self.whole(text), np.uint32)
                continue
            places.append(i)
            group.append(text.encode())
            size += len(group[-1])
            if size >= GROUP_BYTES:
                for k, ids in zip(places, self.encode_group(group), strict=True):
                    out[k] = ids
                places, group, size = [], [], 0
        for k, ids in zip(places, self.encode_group(group), strict=True):
            out[k] = ids
        return out

    def encode_group(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts, none of them empty, by their pieces."""
        if not texts:
            return []
        data, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
        starts = piece_starts(data, begins[:-1])
        first = np.searchsorted(starts, begins)
        long = np.maximum.reduceat(np.diff(starts, append=len(data)), first[:-1]) > self.longest
        if long.any():
            rest = iter(self.encode_group([t for t, x in zip(texts, long, strict=True) if not x]))
            return [np.array(self.whole(t.decode()), np.uint32) if x else next(rest) for t, x in zip(texts, long, strict=True)]
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        which = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = [p for p, i in zip(distinct, which.tolist(), strict=True) if i < 0]
        if len(self.at) + len(new) > self.max_chunks or self.chars + sum(map(len, new)) > self.max_chars:
            self.forget()
            new, which = distinct, np.full(len(distinct), -1)
        if new:
            self.learn(new)
            self.chars += sum(map(len, new))
            which[which < 0] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        order = pieces.indices.to_numpy()
        begin, n = self.bounds[which][order], (self.bounds[which + 1] - self.bounds[which])[order]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]
        if len(self.at) > self.max_chunks or self.chars > self.max_chars:
            self.forget()
        return np.split(ids, ends[first[1:-1] - 1])


def piece_starts(data: bytes, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts put end to end, of which ``texts`` has the starts.

    The pre-tokenizer always cuts before white space that follows something else, after all but the last of the white
    space before a word, after that one too unless it is a space, and between a letter or digit and other ASCII.
    Its rules look ahead only from white space, to whether more follows, so a piece alone is cut as in its text.
    """
    b = np.frombuffer(data, np.uint8)
    white, word = WHITE[b], WORD[b]
    word[1:] |= LEAD[b[:-1]] & TRAIL[b[1:]]
    start = np.zeros(len(b), bool)
    start[1:] = white[1:] & ~white[:-1] | word[:-1] & OTHER[b[1:]]
    last = white[:-1] & ~white[1:]
    last[texts[1:] - 1] = False
    start[:-1] |= last
    start[1:] |= last & (b[:-1] != 32)
    start[texts] = True
    return np.flatnonzero(start)


def cuts_at_space(tokenizer: str) -> bool:
    """Whether the tokenizer, as JSON, is byte-level without anything that looks across white space."""
    rules = json.loads(tokenizer)
    first = rules.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not rules.get("normalizer")
    return plain and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in rules.get("added_tokens") or ())


def grown(values: np.ndarray, n: int) -> np.ndarray:
    """values with room for n; doubled, so that appending is linear."""
    if n <= len(values):
        return values
    out = np.zeros(max(n, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, n_tokens, and value: crc32 and compressed ids of the text and the end id."""

    def make():
        enc = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)

        def fn(texts: list) -> dict:
            n, values = [], []
            for ids in enc.encode_batch(texts):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n.append(len(ids))
                crc = struct.pack("<I", zlib.crc32(ids.tobytes()))
                values.append(crc + pack.compress(ids.astype(f"<u{enc.width}").tobytes()))
            return {"n_tokens": n, "value": values}

        return fn

    return map_texts(docs, make, "n_tokens long, value binary", text, keep)


def sort_key(value: int | None) -> bytes:
    return b"\0" if value is None else b"\1" + ((value + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def from_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def bloom_places(key: bytes, k: int, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    """One shard; keys must come in order."""

    def __init__(self, out, width: int, block_bytes: int = 64 << 10, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.block, self.index, self.keys = bytearray(), bytearray(), []
        self.offset = self.n_docs = self.n_ids = 0
        self.last = b""
        self.first: bytes | None = None

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if key != self.last or self.first is None:
            self.keys.append(zlib.crc32(key) | zlib.crc32(key, 0x9E3779B9) << 32)
        self.first = key if self.first is None else self.first
        self.last = key
        self.n_docs += 1
        self.n_ids += n_ids
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index += varint(len(self.last)) + self.last + varint(self.offset) + varint(len(data))
            self.offset += len(data)
            self.block = bytearray()

    def close(self) -> int:
        self.flush()
        bits = max(64, -(-len(self.keys) * self.bits_per_key // 8) * 8)
        k, field = max(1, round(self.bits_per_key * 0.69)), np.zeros(bits, np.uint8)
        both = np.array(self.keys, np.uint64)
        a, b = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64) | 1
        for i in range(k):
            field[(a + i * b) % bits] = 1
        bloom = bytes([k]) + np.packbits(field).tobytes()
        self.out.write(bytes(self.index) + bloom)
        self.out.write(FOOTER.pack(self.offset, len(self.index), self.offset + len(self.index), len(bloom), self.n_docs, self.n_ids))
        self.out.write(TAIL.pack(self.width, b"", MAGIC))
        return self.offset + len(self.index) + len(bloom) + FOOTER_BYTES


class Reader:
    """One shard, from a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER_BYTES)
        tail = file.read(FOOTER_BYTES)
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids = FOOTER.unpack(tail[: FOOTER.size])
        self.width, _, magic = TAIL.unpack(tail[FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(at)
        index = file.read(n)
        file.seek(bloom_at)
        self.bloom = file.read(bloom_n)
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        i = 0
        while i < n:
            size, i = read_varint(index, i)
            self.last_keys.append(index[i : i + size])
            offset, i = read_varint(index, i + size)
            length, i = read_varint(index, i)
            self.places.append((offset, length))

    def may_hold(self, key: bytes) -> bool:
        bits = 8 * (len(self.bloom) - 1)
        return all(self.bloom[1 + p // 8] >> (7 - p % 8) & 1 for p in bloom_places(key, self.bloom[0], bits))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length = self.places[i]
        self.file.seek(offset)
        data = self.file.read(length)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block is damaged")
        at, key, end = 0, b"", length - 4
        while at < end:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of each document with the key."""
        if not self.places or not self.may_hold(key):
            return []
        out = []
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.places)):
            for k, value in self.block(i):
                if k == key:
                    out.append(self.ids(value))
                elif k > key:
                    return out
        return out

    def ids(self, value: bytes) -> np.ndarray:
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(value[4:]), f"<u{self.width}").astype("<u4")
        if zlib.crc32(ids.tobytes()) != struct.unpack("<I", value[:4])[0]:
            raise ValueError("a document's ids are damaged")
        return ids


def shard_places(docs: DataFrame, shards: int) -> tuple[int, Callable[[Column, Column], Column]]:
    """How many places the keys of column key are dealt to, and the place of a key by its row's number.

    Quantiles of about SAMPLE sampled keys a shard cut the keys in about ``shards`` ranges. A key that is several
    quantiles fills as many places, and so do null keys by their number; their rows are dealt by number,
    so that equal ones are dealt as well.
    """
    n = docs.agg(F.count("*").alias("n"), F.count("key").alias("keys")).first().asDict()
    nulls = -(-(n["n"] - n["keys"]) * shards // n["n"]) if n["n"] else 0
    held = docs.where("key is not null")
    asked = SAMPLE * shards
    known = sorted(r[0] for r in (held.sample(1.2 * asked / n["keys"], 4) if n["keys"] > 1.2 * asked else held).collect()) if shards > 1 else []
    cuts = [known[i * len(known) // shards] for i in range(1, shards)] if known else []
    times = Counter(cuts)
    bounds = sorted(times)
    leaves, place = [(nulls, 0, None)], nulls + 1  # the leaf's place, how many its bound alone fills before it, the bound
    for b in bounds:
        several = times[b] if times[b] > 1 else 0
        leaves.append((place + several, several, b))
        place += several + 1

    def at(key: Column, number: Column) -> Column:
        def leaf(i: int) -> Column:
            here, several, bound = leaves[i]
            if not several:
                return F.lit(here)
            return F.when(key == bound, here - several + F.pmod(number, F.lit(several)).cast("int")).otherwise(here)

        nameless = F.pmod(number, F.lit(max(nulls, 1))).cast("int")
        return F.when(key.isNull(), nameless).otherwise(tree(key, bounds, 0, len(bounds), leaf))

    return place, at


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = 2,
    text: str = "text",
    key: str = "doc_id",
    shards: int | None = None,
    max_file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write documents to shards; the manifest, one row a file, with the columns of SHARD.

    ``shards``: ranges of keys, by default the session's shuffle partitions. A range whose ids
    exceed ``max_file_bytes`` takes several files.
    """
    spark = docs.sparkSession
    folder = (folder or new_folder(spark, "sst")).rstrip("/")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places, at = shard_places(docs.select(F.col(key).cast("long").alias("key")), shards)
    encoded = encode(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), tokenizer, end_id, "text", ["key"])
    placed = encoded.withColumn("place", at(F.col("key"), F.monotonically_increasing_id()).cast("int"))
    dealt = placed.repartitionById(places, "place").sortWithinPartitions("place", "key", "value")
    width = 2 if _vocab_size(tokenizer) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_fs(folder)
        done: list[tuple] = []
        writer = file = name = place = None

        def finish() -> None:
            size = writer.close()
            file.close()
            system.move(f"{top}/{name}.part", f"{top}/{name}")
            done.append((place, len(done), f"{folder}/{name}", writer.first, writer.last, writer.n_docs, writer.n_ids, size))

        for batch in batches:
            for k, n, value, here in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if writer is not None and (writer.offset > max_file_bytes or here != place):
                    finish()
                    writer = None
                if writer is None:
                    system.create_dir(top, recursive=True)
                    name, place = f"{uuid.uuid4().hex}.sst", here
                    file = system.open_output_stream(f"{top}/{name}.part")
                    writer = Writer(file, width)
                writer.add(sort_key(k), value, n)
        if writer is not None:
            finish()
        if done:
            columns = zip(*done, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in SHARD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return checkpointed(dealt.mapInArrow(run, SHARD))


def tree(value: Column, bounds: list[int], lo: int, hi: int, leaf: Callable[[int], Column]) -> Column:
    """The leaf for how many bounds are at most the value, by binary search."""
    if lo == hi:
        return leaf(lo)
    mid = (lo + hi) // 2
    return F.when(value < bounds[mid], tree(value, bounds, lo, mid, leaf)).otherwise(tree(value, bounds, mid + 1, hi, leaf))


def _vocab_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def open_shard(uri: str) -> Reader:
    system, path = open_fs(uri)
    size = system.get_file_info(path).size
    return Reader(io.BufferedReader(system.open_input_file(path)), size)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone.

    The ids of earlier files come from a running sum over the manifest, one row a file.
    """
    placed = manifest.withColumn(
        "start",
        F.coalesce(F.sum("n_ids").over(Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("path", "start", "n_docs", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n_docs, n_ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                reader = open_shard(path)
                if (reader.n_docs, reader.n_ids) != (n_docs, n_ids):
                    raise ValueError(f"{path} is not the file of the manifest")
                rows: list[tuple] = []
                for key, value in reader:
                    ids = reader.ids(value)
                    rows.append((from_key(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    files = placed.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ids of the documents with the keys asked for.

    Keys are joined to the files whose key range holds them, dealt by file, and looked up there
    by Bloom filter, sparse index and block. A key that is asked for twice is answered once, a null
    key finds the documents without one, and each of several documents of a key is a row.
    """
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct()
    ranges = manifest.select("path", "first_key", "last_key")
    unsigned = F.lpad(F.hex(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    dealt = asked.withColumn("k", F.unhex(F.when(F.col("key").isNull(), "00").otherwise(F.concat(F.lit("01"), unsigned)))).join(ranges, F.col("k").between(F.col("first_key"), F.col("last_key"))).select("path", "key", "k").repartition("path").sortWithinPartitions("path", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_open, reader = None, None
        for batch in batches:
            out_keys, out_ids = [], []
            for path, k, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != path_open:
                    path_open, reader = path, open_shard(path)
                for ids in reader.get(raw):
                    out_keys.append(k)
                    out_ids.append(ids.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.int64()), pa.array(out_ids, pa.list_(pa.int64()))], names=[key, "ids"])

    return dealt.mapInArrow(run, f"{key} long, ids array<long>")


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; spark.linkwright.tokenizer overrides it. The file must be on every machine."""
    set_ = spark.conf.get("spark.linkwright.tokenizer", None)
    if set_:
        return set_
    import public_tokenizers

    return public_tokenizers.path(name)
