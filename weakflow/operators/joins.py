"""Joins that keep working when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 5_000_000  # rows of one key and side that a task joins at most
PAIRS_PER_ROW = 10  # result rows of one key that a task makes at most, per hot row


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` may be sent to all tasks. The measurement is one aggregation over ``df``, so
    pass a stored or cheap table."""
    width: Column = F.lit(16 * len(df.columns))
    for c in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return size <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring it; beyond the bound it stays a shuffle join."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def key_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per key, combined before the shuffle."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(
    left_sizes: DataFrame, right_sizes: DataFrame | None, key: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """A stored table (key, lparts, rparts) of the keys to split, however many there are.

    Both sizes of a key count, and so does their product, which is what a task has to write.
    Without ``right_sizes`` a key occurs once on the right at most.
    """
    if right_sizes is None:
        sized = left_sizes.select(key, F.col("n").alias("nl"), F.lit(1).cast("long").alias("nr"))
    else:
        right = right_sizes.select(key, F.col("n").alias("nr"))
        sized = left_sizes.select(key, F.col("n").alias("nl")).join(right, key, "left").fillna(1, ["nr"])
    rparts = F.ceil(F.col("nr") / hot_rows)
    pairs = F.col("nl") * F.ceil(F.col("nr") / rparts).cast("double")
    lparts = F.greatest(F.ceil(F.col("nl") / hot_rows), F.ceil(pairs / (hot_rows * PAIRS_PER_ROW)))
    hot = sized.select(key, F.least(lparts, F.col("nl")).cast("int").alias("lparts"), rparts.cast("int").alias("rparts"))
    return stage(hot.filter("lparts > 1 OR rparts > 1"), "hot-keys")


def _part_of_row(df: DataFrame, parts: str) -> Column:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.when(F.col(parts) == 1, F.lit(0)).otherwise(F.pmod(row, F.col(parts)).cast("int"))


def _every_part(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def cut_sides(
    left: DataFrame, right: DataFrame, key: str, hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a left join with the part of each row: ``_lpart`` and ``_rpart``, to be joined
    with the key. The left side also says how many parts the right one has (``_rparts``), and the right
    side that it was there (``_matched``). Keys must not be NULL."""

    def marked(df: DataFrame) -> DataFrame:
        named = hot.select(key, F.col("lparts").alias("_lparts"), F.col("rparts").alias("_rparts"))
        return df.join(named, key, "left").fillna(1, ["_lparts", "_rparts"])

    cut_left = marked(left).withColumn("_lpart", _part_of_row(left, "_lparts"))
    cut_left = cut_left.withColumn("_rpart", _every_part("_rparts")).drop("_lparts")
    cut_right = marked(right).withColumn("_rpart", _part_of_row(right, "_rparts"))
    cut_right = cut_right.withColumn("_lpart", _every_part("_lparts")).drop("_lparts", "_rparts")
    return cut_left, cut_right.withColumn("_matched", F.lit(True))


def join_cut_sides(cut_left: DataFrame, cut_right: DataFrame, key: str) -> DataFrame:
    joined = cut_left.join(cut_right, [key, "_lpart", "_rpart"], "left")
    # A key that is hot on the right has matches in some of its parts; the others add no row.
    return joined.filter((F.col("_rparts") == 1) | F.col("_matched"))


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_sizes: DataFrame | None = None,
    right_sizes: DataFrame | None = None,
    right_unique: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` with hot keys split over tasks.

    Rows with a NULL key match nothing and bypass the join. The sizes of the other keys are
    measured first, unless (key, n) tables are given. A key that is hot on one side, or whose
    product of both sides is large, is cut into parts on one side and copied to each part on the
    other. The hot keys are a stored table, so a small one is broadcast and a large one is joined
    by a shuffle. Parts come from a hash of the row, so a repeated task makes the same parts.
    """
    named = left.filter(F.col(key).isNotNull())
    others = [c for c in right.columns if c != key]
    kinds = {f.name: f.dataType for f in right.schema}
    unnamed = left.filter(F.col(key).isNull()).withColumns(
        {c: F.lit(None).cast(kinds[c]) for c in others}
    )
    right = right.filter(F.col(key).isNotNull())
    if left_sizes is None:
        left_sizes = key_sizes(named, key)
    if right_sizes is None and not right_unique:
        right_sizes = key_sizes(right, key)
    hot = hot_keys(left_sizes, right_sizes, key, hot_rows)
    columns = [key, *[c for c in left.columns if c != key], *others]
    if hot.isEmpty():
        joined = named.join(right, key, "left")
        return joined.select(*columns).unionByName(unnamed.select(*columns))

    kept = join_cut_sides(*cut_sides(named, right, key, hot), key)
    return kept.select(*columns).unionByName(unnamed.select(*columns))


def expand_copies(df: DataFrame, copies: str, number: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``copies`` times, numbered from 0, without large arrays in memory."""
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / chunk))
    in_piece = F.least(F.lit(chunk), F.col(copies) - F.col("_piece") * chunk) - 1
    return (
        df.withColumn("_piece", F.explode(pieces))
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), in_piece)))
        .withColumn(number, F.col("_piece") * chunk + F.col("_i"))
        .drop("_piece", "_i", copies)
    )
