"""Continuous page analysis: the batch analysis applied to pages as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weakflow.operators.classify import NaiveBayes
from weakflow.operators.reports import analyze_pages
from weakflow.schemas import PAGES


def read_page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages from the Parquet files that land in a folder."""
    reader = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_page_analysis(
    pages: DataFrame,
    vocab: DataFrame,
    model: NaiveBayes,
    labels: DataFrame,
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append the analysis of each page to a Parquet folder.

    Every step is stateless, so the query needs no watermark, and the file sink writes
    each page exactly once.
    """
    analysis = analyze_pages(pages, vocab, model, labels, F.current_timestamp())
    writer = analysis.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(output)
