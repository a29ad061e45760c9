"""Operator 7, mixing sources to target weights by a time-varying curriculum.

Each source has a target in words (water-filling of the total demand by weight, none above a
multiple of its own size) and a schedule: the rate at which it is drawn at time t in [0, 1], here
linear between a start and an end weight. The schedule's integral, scaled to the source's taken
words, is its cumulative demand; a document that covers the words around c of the source's
stream is trained at the time t at which the demand reaches c. Documents of all sources are
then sorted by ranges of that time.

Within a source the stream is a fixed hash order of its documents, whole passes first, then a
part. Running sums come in two steps, over ranges of the order and within a range, so neither a
source nor an id that a third of the rows bear, nor rows alike in all columns, is the work of one
task. So do those over the sources themselves, as there may be as many as hosts. The plan moves only
numbers. All arithmetic that decides is on whole numbers or repeats exactly.

Defined cases: a null text has size 0 and is never taken; null sources are one source, the last;
repeated rows are separate documents, each with copies of its own; sources without words have target
0; extra columns stay, but for one named position, which training_order replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, row_hash

WEIGHTS = (3, 1, 2)
#: A table of more sources than this meets the documents by a shuffle, which adaptive execution splits.
BROADCAST_SOURCES = 100_000
#: Rate of drawing at the start and the end of training, for the sources of each weight in turn.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def n_words(text: str = "text") -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sums_before(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before in the order.

    Rows are dealt by ranges of the order and summed within; only one row a range is summed up in
    one task, and sent to all.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("range_").agg(*(F.sum(c).alias(f"{n}_") for n, c in sums.items()))
    ranges = ranges.select("range_", *(F.coalesce(F.sum(f"{n}_").over(earlier), F.lit(0)).alias(f"{n}_") for n in sums))
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_0") for n, c in sums.items()))
    return within.join(F.broadcast(ranges), "range_").select(*df.columns, *((F.col(f"{n}_") + F.col(f"{n}_0")).alias(n) for n in sums))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, rank, target for a table of sources and their sizes.

    ``share`` is the demand as a fraction of all sizes. Sources in code-point order (null last)
    take the weights in turn. A target stops at ``most`` times its source's size, and what is
    over is shared again by weight until none is above: with the sources in order of
    most * size / weight, the first k stop, for the least k whose level the next one bears.
    """
    cycle = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    table = sums_before(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], rank=F.lit(1))
    table = table.withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    table = table.withColumn("cap", most * F.col("source_size")).withColumn("k", F.col("cap") / F.col("weight"))
    table = checkpointed(sums_before(table, [F.col("k"), F.col("rank")], stopped=F.col("cap"), weight_before=F.col("weight")))
    every = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    unit = 2 * share[1]  # demands are in units of 1 / unit words
    table = (
        table.withColumn("open_weight", F.lit(every.weight) - F.col("weight_before"))
        .withColumn("left", F.lit(2 * share[0] * every.size) - F.lit(unit) * F.col("stopped"))
        # The level if all before this one stop; it bears that level if its cap is no lower.
        .withColumn("bears", F.col("left") * F.col("weight") <= F.col("cap") * F.lit(unit) * F.col("open_weight"))
        .withColumn("level", F.col("left").cast("double") / (F.lit(unit) * F.col("open_weight")))
    )
    first = table.where("bears").agg(F.min(F.struct("k", "rank", "level")).alias("c")).first().c
    if first is None:
        return table.select("source", "source_size", "rank", F.col("cap").cast("double").alias("target"))
    under = (F.col("k") > first.k) | ((F.col("k") == first.k) & (F.col("rank") >= first.rank))
    return table.select("source", "source_size", "rank", F.when(under, F.lit(first.level) * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def schedule_time(c: Column, rank: Column, schedules: Sequence[tuple[float, float]] = SCHEDULES) -> Column:
    """The time at which the share c of a source's words has been drawn: its integral, inverted."""
    out = None
    for i, (a, b) in enumerate(schedules):
        # a t + (b - a) t^2 / 2 = c (a + b) / 2
        root = c if a == b else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + c * ((b - a) * (a + b)))) - a) / (b - a)
        case = F.pmod(rank, F.lit(len(schedules))) == i
        out = F.when(case, root) if out is None else out.when(case, root)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """key, row, size, source, source_size, target, taken, copies, positions: the plan, without texts.

    ``row`` is a hash of all of the document's columns, ``positions`` has the training time of each copy. A document joins the last, partial pass
    if its middle lies before the words still wanted, so a source misses its target by half a
    document at most.
    """
    slim = docs.select(F.col(key).alias("key"), row_hash(docs).alias("row"), F.col(source).alias("source"), n_words(text).alias("size"))
    h = F.md5(F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("-")), F.col("size").cast("string")).cast("binary"))
    slim = checkpointed(slim.withColumn("h", h)).withColumn("nth", F.monotonically_increasing_id())
    sizes = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sizes = sums_before(sizes, [F.col("rank")], source_begin=F.col("source_size")).withColumnRenamed("source", "source_")
    if sizes.count() <= BROADCAST_SOURCES:
        sizes = F.broadcast(sizes)
    stream = sums_before(slim, [F.col("source").asc_nulls_last(), F.col("h"), F.col("key"), F.col("size"), F.col("row"), F.col("nth")], before=F.col("size"))
    placed = stream.join(sizes, F.col("source").eqNullSafe(F.col("source_"))).select(
        "key", "row", "source", "size", (F.col("before") - F.col("source_begin")).alias("begin"), "source_size", "rank", "target"
    )
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("begin") + F.col("size") / 2 < rest) & (F.col("size") > 0)
    copies = F.when(F.col("size") == 0, 0).otherwise(whole + extra.cast("long")).cast("int")
    placed = placed.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    middle = lambda k: (k * F.col("source_size") + F.col("begin") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    at = F.when(F.col("copies") == 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: schedule_time(F.least(middle(k), F.lit(1.0)), F.col("rank"), schedules))
    )
    return placed.select(F.col("key").alias(key), "row", "size", "source", "source_size", "target", "taken", "copies", at.alias("positions"))


def training_order(docs: DataFrame, plan: DataFrame, key: str = "doc_id", shards: int | None = None) -> DataFrame:
    """docs, one row for each copy the plan takes, with position, sorted by ranges of position.

    A document meets its copies by its key and the hash of its row; of rows alike in all columns one
    meets the copies of all, which gives the same rows. Copies are then dealt to ``shards`` equal
    ranges of time, not by sampling, as the plan's demand is known. The texts move twice, to their
    copies and to their place.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "position"]
    rows = docs.select(F.struct(*columns).alias("doc"), F.col(key).alias("key"), row_hash(docs).alias("row"))
    alike = checkpointed(plan.groupBy(F.col(key).alias("key"), "row").agg(F.count("*").alias("n")).where("n > 1"))

    def same(other: DataFrame):
        return (rows["row"] == other["row"]) & rows["key"].eqNullSafe(other["key"])

    if not alike.isEmpty():
        one = rows.join(alike, same(alike), "left_semi").groupBy("key", "row").agg(F.first("doc").alias("doc"))
        rows = rows.join(alike, same(alike), "left_anti").unionByName(one.select("doc", "key", "row"))
    copies = plan.where("copies > 0").select(F.col(key).alias("key"), "row", F.explode("positions").alias("position"))
    dealt = rows.join(copies, same(copies)).select("doc", rows["key"], "position")
    shard = F.least(F.floor(F.col("position") * shards), F.lit(shards - 1)).cast("int")
    return dealt.repartitionById(shards, shard).sortWithinPartitions("position", "key").select("doc.*", "position")
