"""Proportional stratified interleaving of rows into shards (DataFrame functions only).

The rows of each source are put into a seeded order and numbered; row r of n gets the
fractional rank (r - 1 + u) / n, where u in [0, 1) is a seeded offset of the source. All rows
sorted by fractional rank form one sequence in which every stretch holds each source in its
share of the whole; the sequence is cut into shards whose row counts differ by one at most.

No source is numbered in one task: rows are first counted per (source, hash prefix), and
only the rows of one prefix, about ``ROWS_PER_BUCKET``, are sorted together. The same is done
for the merged sequence, where buckets are ranges of the fractional rank.

NULL sources form a stratum of their own. NULL or repeated ids keep all their rows (the same
row twice takes two places). A NULL text has size 8 and the checksum of nothing. An empty
table gives no rows. Columns other than the named ones are not read.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

SHARDS = 24
SEED = "mixture-1"
ROWS_PER_BUCKET = 50_000
HEADER_BYTES = 8


def _leading(hexa: Column, digits: int) -> Column:
    """The first hex digits as a number."""
    return F.conv(F.substring(hexa, 1, digits), 16, 10).cast("long")


def described(df: DataFrame, key: str, source: str, text: str, seed: str) -> DataFrame:
    """(key, size, text_crc32, stratum, u, order): all that is needed of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("NULL"))
    mark = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    return df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole).cast("long") + HEADER_BYTES).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        stratum.alias("stratum"),
        (_leading(F.md5(F.concat(F.lit(seed + "/"), stratum)), 8) / F.lit(float(1 << 32))).alias("u"),
        F.md5(F.concat(F.lit(seed + ":"), mark)).alias("order"),
    )


def interleave(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    shards: int = SHARDS,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(doc_id, stratum, size, text_crc32, position, shard, slot) for every row of ``df``."""
    rows = stage(described(df, key, source, text, seed), "shard-rows")
    total = rows.count()
    digits = max(1, math.ceil(math.log(max(1, total / rows_per_bucket), 16)))
    if total == 0:
        digits = 1
    ties = ["order", "doc_id", "size", "text_crc32"]

    # Rank inside the source: rows of smaller hash prefixes, then the place in the prefix.
    rows = rows.withColumn("bucket", _leading(F.col("order"), digits))
    sizes = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    of_source = Window.partitionBy("stratum")
    earlier = of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(of_source).alias("n_source"),
    )
    inside = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*ties))
    ranked = rows.withColumn("inside", inside).join(sizes, ["stratum", "bucket"])
    fraction = (F.col("before") + F.col("inside") - 1 + F.col("u")) / F.col("n_source")
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "order", fraction.alias("fraction"))
    ranked = stage(ranked, "shard-fractions")

    # Position in the merged sequence, in the same way over ranges of the fraction.
    parts = max(1, math.ceil(total / rows_per_bucket))
    ranked = ranked.withColumn("bucket", F.floor(F.col("fraction") * parts))
    sizes = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = Window.partitionBy("bucket").orderBy("fraction", "stratum", *ties)
    placed = ranked.withColumn("inside", F.row_number().over(place)).join(sizes, "bucket")
    position = F.col("before") + F.col("inside") - 1
    exact = F.expr(f"CAST((position * {shards}) DIV {max(1, total)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return (
        placed.withColumn("position", position)
        .withColumn("shard", exact)
        .select(
            "doc_id",
            "stratum",
            "size",
            "text_crc32",
            "position",
            "shard",
            (F.col("position") - first).alias("slot"),
        )
    )
