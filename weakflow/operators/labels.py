"""Label counts, dictionaries, encoding, rare-class filtering and class weights.

Windows here run over label tables (one row per class), never over data rows. Pass stored
dictionaries: their true size lets the optimizer broadcast them, or shuffle a very large one.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weakflow.sources.staging import stage


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_dictionary(labels: DataFrame, label: str) -> DataFrame:
    """(label, idx): distinct labels in code-point order, numbered from 0."""
    distinct = labels.filter(F.col(label).isNotNull()).select(label).distinct()
    idx = F.row_number().over(Window.orderBy(label)) - 1
    return distinct.select(F.col(label).alias("label"), idx.cast("int").alias("idx"))


def label_encode(df: DataFrame, dictionary: DataFrame, label: str, index: str = "y") -> DataFrame:
    """Adds the class index; rows whose label is not in the dictionary are dropped."""
    names = dictionary.select(F.col("label").alias(label), F.col("idx").alias(index))
    return df.join(names, label)


def drop_rare_labels(df: DataFrame, label: str, min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows of labels with at least ``min_samples`` rows, re-numbered, and the final dictionary."""
    counts = stage(label_counts(df, label), "label-counts")
    kept = counts.filter((F.col("n") >= min_samples) & F.col(label).isNotNull())
    rows = df.join(kept.select(label), label, "left_semi")
    dictionary = stage(label_dictionary(kept, label), "dictionary")
    return label_encode(rows, dictionary, label), dictionary


def class_weights(counts: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with the balanced weight n_all / (classes * n)."""
    whole = Window.partitionBy()
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))
