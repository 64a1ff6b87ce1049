"""Counts that ride along with a write, so that dropped rows cost no scan of their own."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weakflow.operators.labels import label_counts
from weakflow.sources.staging import stage


def stage_counted(df: DataFrame, name: str, keep: Column, **reasons: Column) -> tuple[DataFrame, dict[str, int]]:
    """Stage the rows for which ``keep`` holds, and count in the same pass all rows (``rows``) and those
    for which each reason holds. A NULL reason does not hold. An empty table gives zeros."""
    seen = Observation()
    counts = [F.count_if(F.coalesce(reason, F.lit(False))).alias(key) for key, reason in reasons.items()]
    kept = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).filter(keep), name)
    return kept, dict(seen.get)


def drop_report(
    df: DataFrame, text: str, label: str, tokens: Column, min_samples: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(kept rows with ``tokens``, report of (reason, n)) for training rows.

    Each dropped row counts once, for the first of: unlabelled, blank text, empty sequence, rare label.
    The table is read once; labels are counted on the rows that were written.
    """
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    unlabelled = F.col(label).isNull()
    with_tokens = df.withColumn("tokens", F.when(~unlabelled & ~blank, tokens))
    empty = ~unlabelled & ~blank & (F.size("tokens") == 0)
    kept, n = stage_counted(
        with_tokens, "kept-rows", ~unlabelled & ~blank & ~empty, unlabelled=unlabelled, blank=~unlabelled & blank, empty=empty
    )
    counts = stage(label_counts(kept, label), "label-counts")
    common = counts.filter(F.col("n") >= min_samples)
    rare = counts.agg(F.sum(F.when(F.col("n") < min_samples, F.col("n")).otherwise(0))).first()[0] or 0
    spark = df.sparkSession
    left = n["rows"] - n["unlabelled"] - n["blank"] - n["empty"] - rare
    rows = [("rows", n["rows"]), *[(k, n[k]) for k in ("unlabelled", "blank", "empty")], ("rare", rare), ("kept", left)]
    report = spark.createDataFrame(rows, "reason string, n long")
    return kept.join(common.select(label), label, "left_semi"), report
