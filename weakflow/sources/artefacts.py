"""Stored artefacts: vocabulary, label dictionary, model tables and run metadata."""

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.operators.classify import NaiveBayes

_LINE = r"^(.*):(\d+)$"


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, n long, idx long").parquet(path)


def label_lines(dictionary: DataFrame) -> DataFrame:
    """One ``label:idx`` line per class; the label is kept as it is."""
    line = F.concat_ws(":", "label", F.col("idx").cast("string"))
    return dictionary.select(line.alias("value"))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """(label, idx), trimmed for serving. The last colon separates, so labels may hold colons."""
    text = F.trim("value")
    parsed = lines.select(
        F.trim(F.regexp_extract(text, _LINE, 1)).alias("label"),
        F.regexp_extract(text, _LINE, 2).alias("idx"),
    )
    return parsed.filter(F.col("idx") != "").withColumn("idx", F.col("idx").cast("int"))


def save_label_dictionary(dictionary: DataFrame, path: str) -> None:
    label_lines(dictionary).write.mode("overwrite").text(path)


def load_label_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_lines(spark.read.text(path))


def save_model(
    model: NaiveBayes, vocab: DataFrame, dictionary: DataFrame, path: str, max_len: int = 300
) -> None:
    """Everything that scoring needs, under one path. The final label dictionary always goes
    with the model, so a model cannot be served with the labels of another one."""
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")
    model.cells.write.mode("overwrite").parquet(f"{path}/cells")
    save_vocabulary(vocab, f"{path}/vocabulary")
    save_label_dictionary(dictionary, f"{path}/labels")
    meta = dictionary.agg(F.count(F.lit(1)).alias("num_classes")).withColumn("max_len", F.lit(max_len))
    meta.write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[NaiveBayes, DataFrame, DataFrame, DataFrame]:
    """(model, vocabulary, label dictionary, metadata)."""
    classes = spark.read.schema("y int, label string, prior long, base long")
    cells = spark.read.schema("y int, idx int, delta long")
    model = NaiveBayes(classes.parquet(f"{path}/classes"), cells.parquet(f"{path}/cells"))
    meta = spark.read.schema("num_classes long, max_len int").json(f"{path}/meta")
    return (
        model,
        load_vocabulary(spark, f"{path}/vocabulary"),
        load_label_dictionary(spark, f"{path}/labels"),
        meta,
    )


def save_regression(
    counter: CountVectorizerModel, regression: LogisticRegressionModel, path: str
) -> None:
    counter.write().overwrite().save(f"{path}/counter")
    regression.write().overwrite().save(f"{path}/regression")


def load_regression(path: str) -> tuple[CountVectorizerModel, LogisticRegressionModel]:
    return (
        CountVectorizerModel.load(f"{path}/counter"),
        LogisticRegressionModel.load(f"{path}/regression"),
    )
