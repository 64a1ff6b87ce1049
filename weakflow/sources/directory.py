"""A sorted table with a page directory: any page of rows is read from the files that hold it.

The rows are dealt out by ranges of the order and sorted inside each, so a file holds neighbours. The
directory has one row per file: which rows of the whole order it holds, and its first and last key. It is
written after the rows, and a table without it cannot be opened, so a half-written table is never read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weakflow.operators.ranks import numbered_ranges
from weakflow.sources.staging import stage

ROWS_PER_FILE = 5_000_000
_OWN = ("_range", "_place")


def write_directory(
    df: DataFrame, order_by: list[str], path: str, rows_per_file: int = ROWS_PER_FILE
) -> "PageDirectory":
    """Write ``df`` in ascending order (NULL first) under a new ``path``.

    Rows with equal keys keep one order among themselves, fixed by the write. Columns named ``_range``
    or ``_place`` are refused. An empty table has an empty directory and empty pages.
    """
    taken = [c for c in _OWN if c in df.columns]
    if taken:
        raise ValueError(f"the directory uses these column names itself: {taken}")
    spark = df.sparkSession
    # Ranges are drawn from a sample, so the rows are read twice; stored, they are computed once.
    numbered = numbered_ranges(stage(df, "unordered"), [F.col(f"`{c}`") for c in order_by])
    numbered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    # Read without the write's schema check: the files are those that Spark committed.
    rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    key = F.struct(*[F.col(f"`{c}`") for c in order_by])
    per_file = rows.groupBy(F.col("_metadata.file_name").alias("file"), "_range").agg(
        F.min("_place").alias("_first_place"),
        F.count(F.lit(1)).alias("n"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )
    per_file = stage(per_file, "directory")
    sizes = per_file.groupBy("_range").agg(F.sum("n").alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    placed = per_file.join(F.broadcast(before), "_range").select(
        "file",
        "_range",
        "_before",
        (F.col("_before") + F.col("_first_place")).alias("start"),
        "n",
        "first",
        "last",
    )
    placed.write.parquet(f"{path}/directory")
    return PageDirectory(spark, path)


class PageDirectory:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self.files = spark.read.parquet(f"{path}/directory")
        kinds = spark.read.parquet(f"{path}/rows").schema
        self._stored = kinds
        self._key = self.files.schema["first"].dataType
        self.columns = [f.name for f in kinds if f.name not in _OWN]

    def count(self) -> int:
        """Rows of the table, from the directory alone."""
        return self.files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def files_of(self, offset: int, limit: int) -> DataFrame:
        """The files that hold rows ``offset .. offset + limit`` of the order."""
        return self.files.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset .. offset + limit`` of the order, sorted; other files are not opened."""
        rows, number = self._numbered(self.files_of(offset, limit))
        return rows.filter(number.between(offset, offset + limit - 1)).orderBy(number).select(*self._named())

    def after(self, last: tuple | None, limit: int) -> DataFrame:
        """The ``limit`` rows that follow a key, sorted; ``last`` has a value (or None) for each column of
        the order. Read are the file in which the key would stand and those that the page reaches."""
        if last is None:
            return self.page(0, limit)
        if len(last) != len(self._key):
            raise ValueError(f"a key has {len(self._key)} values: {self._key.names}")
        names, kinds = self._key.names, [f.dataType for f in self._key]
        key = F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(last, kinds, names)])
        reach = self.files.filter(F.col("last") > key)
        # Rows of the first file may all lie after the key, or only its last one.
        edge = reach.agg(F.min_by(F.col("start") + F.col("n"), "start")).first()[0]
        if edge is None:
            return self.page(0, 0)
        rows, number = self._numbered(reach.filter(F.col("start") < edge + limit))
        own = F.struct(*[F.col(f"`{c}`") for c in names])
        return rows.filter(own > key).orderBy(number).limit(limit).select(*self._named())

    def _named(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    def _numbered(self, files: DataFrame) -> tuple[DataFrame, Column]:
        """The rows of some files, and the place of each in the whole order, from 0. The files are
        those of one page, so their names are few."""
        found = files.select("file", "_range", "_before").collect()
        if not found:
            return self.spark.createDataFrame([], self._stored), F.col("_place")
        before: Column = F.lit(None).cast("long")
        for r in {r["_range"]: r for r in found}.values():
            before = F.when(F.col("_range") == r["_range"], F.lit(r["_before"])).otherwise(before)
        rows = self.spark.read.schema(self._stored).parquet(
            *[f"{self.path}/rows/{r['file']}" for r in found]
        )
        return rows, before + F.col("_place")


def open_directory(spark: SparkSession, path: str) -> PageDirectory:
    return PageDirectory(spark, path)
