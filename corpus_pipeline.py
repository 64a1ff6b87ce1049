"""A cleaning pipeline over documents: each stage is one of the numbered operators.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of documents;
``run`` writes each result to the shared folder and reads it back for the next stage.

Rows with the same id, or without one, each get their own decision: verdicts are joined back
by a key made of id, text and language. Only in the join of near duplicates is a repeated id
one document: one of its rows stays; rows without an id cannot be grouped there and stay.
Rows without a text fail the quality rules. An empty table passes through all stages. Names of
helper columns avoid those of the input.

While the stages run, Python workers get batches of ``BATCH_ROWS`` rows: an executor holds a
batch on both sides of the pipe, outside of its heap.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.llm import op2_decontamination, op6_packing, op7_toxicity, op8_quality, op9_jaccard
from weakflow.operators.joins import broadcast_if_small
from weakflow.sources.staging import stage

BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """Adds a key that is equal only for rows with the same id, text and language."""
    parts = [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("NULL")),
        F.hex(F.xxhash64("text")),
        F.hex(F.octet_length("text")),
        F.coalesce(F.col("lang"), F.lit("NULL")),
    ]
    return docs.withColumn(key, F.concat_ws("/", *parts))


def _without(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the rejected ones."""
    keys = stage(rejected.select(key).distinct(), "rejected")
    return _keyed(docs, key).join(broadcast_if_small(keys), key, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar calls toxic go."""
    grammar = op7_toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    out = _free(docs, "_toxicity")
    scored = op7_toxicity.score(docs, grammar, out=out)
    return scored.filter(F.col(out) < op7_toxicity.BLOCK_FROM).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie too far from their language go."""
    key = _free(docs, "_key")
    scored = op8_quality.score(_keyed(docs, key), key=key)
    return _without(docs, scored.filter(~F.col("kept")), key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    joined = stage(op9_jaccard.join(docs), "components")
    linked = joined.filter("component_id <> doc_id").select("doc_id").distinct()
    repeated = joined.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stage(repeated.select("doc_id").join(linked, "doc_id", "left_anti"), "repeated-ids")
    duplicates = stage(linked.unionByName(repeated), "duplicates")
    once = docs.join(broadcast_if_small(duplicates), "doc_id", "left_anti")
    one_of = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(one_of).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty stands in a benchmark passage go."""
    key = _free(docs, "_key")
    found = op2_decontamination.contamination(_keyed(docs, key), _table(spark, sf_dir, "benchmark"), key=key)
    return _without(docs, found.filter("contaminated"), key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the length bucket, the batch, and the place in the batch of every document."""
    return op6_packing.pack(docs, op6_packing.token_count("text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the learnt toxicity score; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = _table(spark, sf_dir, "documents")
    spark.conf.set(setting, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        for name, function in STAGES:
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(setting, before)
    return docs
