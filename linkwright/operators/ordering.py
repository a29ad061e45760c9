"""Places and counts within groups of any size: a group larger than a task's share is several tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Bits of an increasing id that tell a row's place in its part.
PLACE_BITS = 33


def parted(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows, sorted by ranges of group and order and written once, with at_ (the place in that order) and part_ (the range).

    The ranges are of like size, whatever the groups are; rows that are equal in group and order share one.
    """
    keys = [F.col(g).asc() for g in group]
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("at_", F.monotonically_increasing_id())
    return stored(ranged).withColumn("part_", F.shiftright("at_", PLACE_BITS))


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], counted: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with place (from 1, within their group by order) and, for each name of ``counted``, how many values its column has in the group.

    ``group`` has no nulls and ``order`` leaves no ties. What is summed within one group is a row for each range that
    it has rows in, never the rows themselves.
    """
    counted = dict(counted or {})
    held = parted(rows, group, order)
    runs = held.groupBy(*group, "part_").agg(F.min("at_").alias("at_least_"), F.count("*").alias("rows_"), *(F.count(c).alias(f"counted_{name}_") for name, c in counted.items()))
    whole = Window.partitionBy(*group)
    before = F.sum("rows_").over(whole.orderBy("part_")) - F.col("rows_")
    runs = runs.select(*group, "part_", (F.col("at_least_") - before).alias("zero_"), *(F.sum(f"counted_{name}_").over(whole).alias(name) for name in counted))
    return held.join(runs, [*group, "part_"]).withColumn("place", F.col("at_") - F.col("zero_") + 1).select(*rows.columns, "place", *counted)
