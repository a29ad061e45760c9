"""Shared helpers of the training-data operators: Arrow mapping over texts, word rules, shared folders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.shared import checkpointed as checkpointed

#: Bytes of "item words": ASCII letters (lower-cased) and digits, and every byte above ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lower-cases A-Z alone, in texts and in bytes.
LOWER_STR = {b: b + 32 for b in range(65, 91)}
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same words over a text that LOWER_STR has lower-cased.
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rows of one Arrow batch; documents are long, so the default of 10,000 would hold too much at once.
BATCH_ROWS = 1000


def item_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased, as UTF-8; None has none."""
    return utf8(text).translate(WORD_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8; None has none."""
    return utf8(text).split() if text else []


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session has set its own bound.

    Spark takes the bound when a plan runs, so it stays set in the session, for its other queries too.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row; columns of a kind that has no hash, such as maps and variants, count by their JSON."""

    def has_hash(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return has_hash(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(has_hash(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    def hashable(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c if has_hash(f.dataType) else F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})

    return F.xxhash64(*map(hashable, df.schema.fields))


def with_hot_keys(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 10_000) -> DataFrame:
    """left joined with right, which has one row a key and in n_ how many of left's ``total`` rows bear it.

    Keys with more than 1 / ``share`` of the rows, of which there are fewer than ``share``, are sent to
    all tasks; the others are shuffled. So no task gets all rows of a hot key. Both are read twice.
    """
    hot = F.col("n_") * share > total
    sent = F.broadcast(right.where(hot).drop("n_"))
    rest = left.join(sent.select(key), key, "left_anti").join(right.where(~hot).drop("n_"), key)
    return left.join(sent, key).unionByName(rest)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    new: str,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns computed from whole texts, batch by batch, beside the kept columns.

    ``make`` is called once per task and gives a function from the list of texts (None for
    null) to a dict of column values. ``new`` is the DDL of those columns. ``keep`` names the
    input columns to return (all, if None); an input column with the name of a new column,
    in either case, is replaced by it. No shuffle, no grouping; rows keep their order.
    """
    small_batches(df.sparkSession)
    fields = T.StructType.fromDDL(new).fields
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch.column(at).to_pylist())
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [as_array(out[f.name], arrow.field(f.name).type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def document_counts(docs: DataFrame, text: str = "text", least_chars: int = 3, held: int = 200_000, hide: re.Pattern | None = None) -> DataFrame:
    """w, n: in how many documents each word stands that is of letters alone and not shorter than that.

    What the first group of ``hide`` matches has no words.

    A task holds at most so many counts at once, and a text's own; they are summed before the shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [(s, n) for w, n in counts.items() if len(w) >= least_chars and (s := w.decode("utf-8", "replace")).isalpha() and len(s) >= least_chars]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["w", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(set(item_words(hidden(t, hide) if hide and t else t)))
                if len(counts) > held:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(text).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def hidden(text: str, pattern: re.Pattern) -> str:
    """text with what the pattern's first group matches put as a space."""
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [text[at : m.start(1)], " "]
        at = m.end(1)
    return "".join([*out, text[at:]])


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
