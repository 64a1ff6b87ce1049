"""Table sources and sinks: CSV, Parquet, header repair, profiling and paging."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    infer: bool = False,
    delimiter: str = ",",
) -> DataFrame:
    """Scan a CSV file with a header.

    With a schema there is no extra pass. Without one every column is a string,
    unless ``infer`` asks for the (costly) inference pass.
    """
    reader = spark.read.option("header", True).option("delimiter", delimiter).option("escape", '"')
    if schema is not None:
        # Matching by position also accepts a blank first header.
        return reader.schema(schema).option("enforceSchema", True).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    # Values are written as they are; by default the writer would strip them.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def repair_header(df: DataFrame, name: str = "cve_id") -> DataFrame:
    """A blank first header arrives as ``_c0``; give it its real name."""
    return df.withColumnRenamed("_c0", name) if "_c0" in df.columns else df


def write_parquet(df: DataFrame, path: str, shared_prefixes: bool = False) -> None:
    """With ``shared_prefixes`` a string is stored without what it shares with the beginning of the one
    before it (Parquet's delta encoding). This pays where neighbouring rows hold long, similar texts."""
    writer = df.write.mode("overwrite")
    if shared_prefixes:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", False)
    writer.parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def profile_columns(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row per column: position, name, type, rows and non-null values, in one pass."""
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]
    if approx_distinct:
        aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)]
    types = dict(df.dtypes)

    def entry(i: int, name: str) -> Column:
        fields = [
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(types[name]).alias("column_type"),
            F.col("n").alias("n_rows"),
            F.col(f"c{i}").alias("n_values"),
        ]
        if approx_distinct:
            fields.append(F.col(f"d{i}").alias("approx_distinct"))
        return F.struct(*fields)

    entries = F.array(*[entry(i, c) for i, c in enumerate(names)])
    return df.agg(*aggs).select(F.inline(entries))


def page_rows(df: DataFrame, order_by: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of a total order, for looking at a page of results."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last: object | None, limit: int) -> DataFrame:
    """Keyset paging: the cost of a page does not grow with its position."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def iterate_rows(df: DataFrame) -> Iterator[Row]:
    """Bulk export one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)
