"""Optimal length buckets, and token-budget batches inside each bucket.

The lengths of all rows are counted into one global histogram (one entry per distinct length,
combined before the shuffle). A dynamic program over that histogram chooses the bucket
boundaries with the least padding: among all ways to cut the sorted lengths into at most
``buckets`` runs, each padded to its longest member, it finds the best one. Its inner minimum
is over lines with falling slopes asked at rising places, so a layer takes linear time.

Inside a bucket rows stand in a seeded order and are cut into batches of
``max(1, budget // boundary)`` rows, so that a padded batch keeps to the token budget. A row
longer than the budget is a batch of its own; nothing is cut or dropped. A bucket is never
numbered in one task: rows are counted per hash prefix first, as many prefixes as keep about
``ROWS_PER_SLICE`` rows together. One pass counts lengths by prefix, and the histogram and the
sizes of the prefixes are sums of that table. Rows without an id are ordered by their content.

The length is the number of words, plus one end token; a NULL text has length 1. Equal rows all
keep a place. An empty table has no buckets and gives no rows. All columns of the input are
kept, except those with the names of the added ones, which are replaced.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

BUCKETS = 16
BUDGET = 32_768
SEED = "batches-1"
ROWS_PER_SLICE = 50_000
ADDED = ("n_tokens", "bucket", "bucket_length", "batch", "place", "padding")


def token_count(text: str) -> Column:
    """Words of a text column, plus one."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return (words + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The longest member of each bucket, ascending, with the least padding.

    ``lengths`` are distinct and ascending. With T tokens in all, padding is the sum over
    buckets of boundary * rows, minus T; so only the sum is minimised.
    """
    m = len(lengths)
    if m == 0:
        return []
    sums = [0, *np.cumsum(counts).tolist()]
    longest = lengths.tolist()
    cost = [longest[j - 1] * sums[j] if j else 0 for j in range(m + 1)]
    choice: list[list[int]] = []
    for _ in range(min(buckets, m) - 1):
        # best(j) = min over i < j of cost[i] + longest[j-1] * (sums[j] - sums[i])
        best, chosen = [0] * (m + 1), [0] * (m + 1)
        lines: list[int] = []
        head = 0
        for j in range(1, m + 1):
            i = j - 1  # this line joins; slopes -sums[i] fall
            while len(lines) - head >= 2:
                a, b = lines[-2], lines[-1]
                if (cost[i] - cost[a]) * (sums[b] - sums[a]) <= (cost[b] - cost[a]) * (sums[i] - sums[a]):
                    lines.pop()
                else:
                    break
            lines.append(i)
            x = longest[j - 1]
            while len(lines) - head >= 2 and cost[lines[head + 1]] - x * sums[lines[head + 1]] <= cost[lines[head]] - x * sums[lines[head]]:
                head += 1
            best[j] = cost[lines[head]] + x * (sums[j] - sums[lines[head]])
            chosen[j] = lines[head]
        choice.append(chosen)
        cost = best
    ends, j = [], m
    for chosen in reversed(choice):
        ends.append(longest[j - 1])
        j = chosen[j]
        if j == 0:
            break
    if j:
        ends.append(longest[j - 1])
    return ends[::-1]


def histogram(counted: DataFrame, length: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct lengths, rows of each), ascending, from counts ``n``."""
    counted = counted.groupBy(length).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(counted[length].to_numpy())
    return counted[length].to_numpy()[order], counted["n"].to_numpy()[order]


def pack(
    df: DataFrame,
    length: Column,
    key: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    seed: str = SEED,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Adds n_tokens, bucket, bucket_length, batch (inside the bucket), place and padding."""
    kept = [c for c in df.columns if c not in ADDED]
    digits = max(1, math.ceil(math.log(max(1.0, df.count() / rows_per_slice), 16)))
    content = F.concat(F.lit("NULL"), F.hex(F.xxhash64(*[F.col(f"_row.`{c}`") for c in kept])))
    mark = F.coalesce(F.col(f"_row.`{key}`").cast("string"), content)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), length.alias("n_tokens"))
    rows = rows.withColumn("_order", F.md5(F.concat(F.lit(seed + ":"), mark)))
    rows = rows.withColumn("_slice", F.substring("_order", 1, digits))
    counted = stage(rows.groupBy("n_tokens", "_slice").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    ends = boundaries(*histogram(counted, "n_tokens"), buckets)
    number, boundary = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        fits = F.col("n_tokens") <= end
        number, boundary = F.when(fits, F.lit(i)).otherwise(number), F.when(fits, F.lit(end)).otherwise(boundary)
    sizes = counted.groupBy(number.alias("bucket"), "_slice").agg(F.sum("n").alias("n"))
    # Dealt out by prefix first, so that the bucket is looked up by a length that is there already.
    rows = rows.repartition("_slice").withColumns({"bucket": number, "bucket_length": boundary.cast("long")})
    earlier = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    sizes = stage(sizes.select("bucket", "_slice", before), "slice-sizes")
    inside = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("_order", "n_tokens"))
    # Every row finds its slice. An inner join would test the bucket for NULL before the deal, by
    # counting the words of a text once for each bucket.
    placed = rows.withColumn("_inside", inside).join(sizes, ["bucket", "_slice"], "left")
    rank = F.col("_before") + F.col("_inside") - 1
    fill = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    return placed.withColumns({"_rank": rank, "_fill": fill}).select(
        *[F.col(f"_row.`{c}`") for c in kept],
        "n_tokens",
        "bucket",
        "bucket_length",
        F.expr("_rank DIV _fill").alias("batch"),
        (F.col("_rank") % F.col("_fill")).alias("place"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
