"""A global number for every row of a sorted table, without sorting it in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

_PLACE_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in these


def numbered_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``_range`` and ``_place``: rows dealt out by ranges of the order, sorted inside them, and
    numbered from 0 in each. The numbers hold for one run, so the result has to be stored."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = ranged.withColumn("_number", F.monotonically_increasing_id())
    return number.withColumns(
        {
            "_range": F.shiftright("_number", _PLACE_BITS),
            "_place": F.col("_number").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
        }
    ).drop("_number")


def rows_before(ranged: DataFrame) -> DataFrame:
    """(_range, _before): rows in all earlier ranges. One row per partition of the ranged table."""
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in the order, from 1, as a 64-bit number.

    One exchange: rows are numbered while they lie sorted in their range, then stored, and the rows
    of the earlier ranges are added (one row per partition, so it is sent to all tasks).
    """
    ranged = stage(numbered_ranges(df, order), "ranges")
    placed = ranged.join(F.broadcast(rows_before(ranged)), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))
