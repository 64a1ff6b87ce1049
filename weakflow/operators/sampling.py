"""Repeatable samples, caps and splits.

Each row is compared with a threshold on its hash, so the choice does not depend on
partitioning and needs no shuffle of the rows. Exact sizes come from small histograms
of the hashes, and are exact also where row keys repeat.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.functions.hashing import below, row_hash
from weakflow.operators.ranks import global_rank
from weakflow.sources.staging import stage

_BITS = 16  # a histogram has at most 2**16 hash prefixes (per class)


def sample_rows(df: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample."""
    return df.filter(below(row_hash(key, seed), fraction))


def label_fractions(counts: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Sampling fraction per label: 0.2 % from 1000 rows, else 3 rows but at most 1 %.

    Small labels can vanish from a sample; ``min_rows`` raises their fractions.
    """
    n = F.col("n").cast("double")
    fraction = F.when(F.col("n") < 1000, F.least(F.lit(3.0) / n, F.lit(0.01))).otherwise(F.lit(0.002))
    if min_rows is not None:
        fraction = F.least(F.lit(1.0), F.greatest(fraction, F.lit(float(min_rows)) / n))
    return counts.withColumn("fraction", fraction)


def sample_stratified(
    df: DataFrame, fractions: DataFrame, key: Column, label: str = "cwe_name", seed: int = 42
) -> DataFrame:
    """Bernoulli sample with a fraction per label; labels without a fraction give no rows.

    Fractions from a stored table have a known size: a small one is broadcast, so the rows
    are not shuffled by label.
    """
    shares = fractions.select(label, F.col("fraction").alias("_fraction"))
    joined = df.join(shares, label)
    return joined.filter(below(row_hash(key, seed), F.col("_fraction"))).select(*df.columns)


def cap_rows(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest hashes.

    The n-th hash is found from histograms, and each row is compared with it: the rows are
    filtered where they are, and no task gathers or sorts them.
    """

    def quotas(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("_all").agg(F.count(F.lit(1)).alias("_n"))
        return counted.select("_all", F.least(F.col("_n"), F.lit(n)).cast("long").alias("quota"))

    marked = mark_lowest(df.withColumn("_all", F.lit(1)), quotas, "_all", key, "_kept", seed)
    return marked.filter("_kept").select(*df.columns)


def split_rows(df: DataFrame, key: Column, train: float = 0.8, seed: int | str = "split") -> DataFrame:
    """Adds ``part``: 'train' for about ``train`` of the rows, else 'test'."""
    chosen = below(row_hash(key, seed), train)
    return df.withColumn("part", F.when(chosen, "train").otherwise("test"))


def split_three(
    df: DataFrame, key: Column, train: float = 0.7, valid: float = 0.1, seed: int | str = "split"
) -> DataFrame:
    """Train, validation and test parts, so that tuning never looks at the test rows."""
    h = row_hash(key, seed)
    part = F.when(below(h, train), "train").when(below(h, train + valid), "valid").otherwise("test")
    return df.withColumn("part", part)


def mark_lowest(
    df: DataFrame,
    quotas: Callable[[DataFrame], DataFrame],
    group: str,
    key: Column,
    flag: str,
    seed: int | str,
) -> DataFrame:
    """Adds a boolean ``flag``: true for the ``quota`` lowest rows of each group.

    ``quotas`` makes (group, quota) of the stored rows, so ``df`` itself is computed once. Rows are
    ordered by (hash, key, number), where the number tells rows with equal keys apart, so exactly ``quota`` rows are marked also where keys repeat or are NULL. NULL
    is a group like any other. Per group, a histogram finds the prefix of the hash that holds the
    quota-th row, and a second one over the rest of the hash the very hash. Where rows share that hash,
    histograms over their keys, and then over steps of their numbers, go on to the very row; each has at
    most 2**17 bins, so a group, or a key, with a third of all rows is never gathered in one task. Every
    row is then compared with its group's row. Hash and number are stored with the rows; what follows
    from these or from the rows' own columns is not. The found rows are stored, so that their size (one per group) decides whether they are broadcast.
    """
    known = F.coalesce(key, F.lit(""))
    hashed = df.withColumns({"_hash": row_hash(known, seed), "_no": F.monotonically_increasing_id()})
    stored = stage(hashed, "hashed")
    # A struct is equal to another one also where both hold NULL.
    hashed = stored.withColumn("_group", F.struct(F.col(group).alias("g")))
    # The upper half of a number is its partition; the lower half counts rows.
    steps = {
        "_prefix": F.shiftright("_hash", 32 - _BITS),
        "_hash": F.col("_hash"),
        "_key": known,
        "_part": F.shiftright("_no", 33),
        "_block": F.shiftright("_no", 16),
        "_no": F.col("_no"),
    }
    rows = hashed.select("_group", *[c.alias(name) for name, c in steps.items()])
    wanted = quotas(stored).select(F.struct(F.col(group).alias("g")).alias("_group"), F.col("quota").alias("_need"))
    cuts = None
    for step in steps:
        counted = rows.groupBy("_group", step).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("_group").orderBy(step))
        found = counted.withColumn("_upto", upto).join(wanted, "_group").filter(
            (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("n") < F.col("_need"))
        )
        bins = found.select("_group", step, (F.col("_need") - F.col("_upto") + F.col("n")).alias("_need"), "n")
        bins = stage(bins, "edges")
        chosen = bins.select("_group", F.col(step).alias(f"_cut{step}"))
        cuts = chosen if cuts is None else cuts.join(chosen, "_group", "left")
        # A bin that is wanted as a whole needs no further look.
        wanted = bins.filter("_need < n").select("_group", "_need")
        if step != "_prefix" and wanted.isEmpty():
            break
        wanted = bins.select("_group", "_need") if step == "_prefix" else wanted
        rows = rows.join(wanted.join(bins, "_group").select("_group", step), ["_group", step])
    cuts = stage(cuts.drop("_cut_prefix"), "cuts")
    low = F.lit(True)
    for step in reversed([step for step in steps if f"_cut{step}" in cuts.columns]):
        value, cut = steps[step], F.col(f"_cut{step}")
        low = (value < cut) | ((value == cut) & low)
        if step != "_hash":
            low = low | cut.isNull()  # all rows up to the step before are wanted
    marked = hashed.join(cuts, "_group", "left").withColumn(flag, F.coalesce(low, F.lit(False)))
    return marked.select(*df.columns, flag)


def split_rows_exact(
    df: DataFrame, key: Column, train: float = 0.8, seed: int | str = "split"
) -> DataFrame:
    """Adds ``part`` with exactly ``floor(n * train)`` training rows."""

    def quotas(rows: DataFrame) -> DataFrame:
        n = F.floor(F.count(F.lit(1)) * F.lit(train)).cast("long")
        return rows.groupBy("_all").agg(n.alias("quota"))

    marked = mark_lowest(df.withColumn("_all", F.lit(1)), quotas, "_all", key, "_train", seed)
    return marked.withColumn("part", F.when(F.col("_train"), "train").otherwise("test")).drop(
        "_all", "_train"
    )


def class_quotas(counts: DataFrame, label: str, test_percent: int = 20) -> DataFrame:
    """(label, n, quota): test rows per class, proportional, summing to ceil(share * n).

    Largest remainders in integer arithmetic. The windows run over the label table.
    """
    total = F.sum("n").over(Window.partitionBy())
    sized = counts.withColumn("_all", total).withColumn(
        "_test", F.floor((F.col("_all") * test_percent + 99) / 100).cast("long")
    )
    # Decimals keep the products exact for any row count.
    every = F.col("_all").cast("decimal(19,0)")
    product = F.col("_test").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    rest = F.col("_product") % every
    shared = sized.withColumn("_product", product).withColumn("_rest", rest)
    shared = shared.withColumn(
        "_base", ((F.col("_product") - F.col("_rest")) / every).cast("long")
    )
    missing = F.col("_test") - F.sum("_base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), label))
    return shared.withColumn("_missing", missing).withColumn("_place", rank).select(
        label,
        "n",
        (F.col("_base") + (F.col("_place") <= F.col("_missing")).cast("long")).alias("quota"),
    )


def split_stratified(
    df: DataFrame, key: Column, label: str, test_percent: int = 20, seed: int | str = "split"
) -> DataFrame:
    """Adds ``part`` with the same share of test rows in every class (exact sizes)."""

    def quotas(rows: DataFrame) -> DataFrame:
        return class_quotas(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, test_percent)

    marked = mark_lowest(df, quotas, label, key, "_test", seed)
    return marked.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def training_order(df: DataFrame, key: Column, seed: int | str = "order", place: str = "place") -> DataFrame:
    """Adds ``place``: the place of each row, from 1, in a repeatable shuffled order, for exporting
    training rows. Ties of the 32-bit hash go by the key, so rows are told apart as far as keys do."""
    ordered = df.withColumns({"_order_hash": row_hash(key, seed), "_order_key": key})
    ranked = global_rank(ordered, [F.col("_order_hash"), F.col("_order_key")], place)
    return ranked.drop("_order_hash", "_order_key")
