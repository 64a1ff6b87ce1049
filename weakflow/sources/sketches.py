"""Column profiles that grow with the input: one mergeable sketch per file and column, stored.

A refresh reads only files that are new or were written again since the last one. The profile of the
whole table is the union of the stored sketches of the files that it has now, so neither a refresh nor a
profile reads old rows again.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

LOG_BUCKETS = 15  # 32 KB per sketch and a standard error below 0.5 percent
_STORED = "file string, changed timestamp, bytes long, position int, column_name string, column_type string, n_rows long, n_values long, sketch binary"

_FILE = {"file": "file_path", "changed": "file_modification_time", "bytes": "file_size"}


def _identity(name: str, kind: object) -> Column:
    """A 64-bit number for each distinct value, NULL for NULL. Sketches skip empty texts, numbers never."""
    value = F.col(f"`{name}`")
    entries = F.array_sort(F.map_entries(value)) if isinstance(kind, MapType) else value
    return F.when(value.isNotNull(), F.xxhash64(entries))


def _files(spark: SparkSession, source: str) -> DataFrame:
    """(file, changed, bytes, path) of a table, from a listing; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    data = listed.filter(F.col("path").endswith(".parquet"))
    return data.select(*[F.col(f"_metadata.{of}").alias(name) for name, of in _FILE.items()], "path")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).parquet(f"{store}/*")


def sketch_rows(df: DataFrame, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """One row per input file and column of a Parquet scan: rows, values and the sketch of the values."""
    keys = [F.col(f"_metadata.{of}").alias(f"_{name}") for name, of in _FILE.items()]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, field in enumerate(df.schema):
        aggs.append(F.count(F.col(f"`{field.name}`")).alias(f"_c{i}"))
        aggs.append(F.hll_sketch_agg(_identity(field.name, field.dataType), F.lit(log_buckets)).alias(f"_s{i}"))
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"),
            F.col("_n").alias("n_rows"),
            F.col(f"_c{i}").alias("n_values"),
            F.col(f"_s{i}").alias("sketch"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    per_file = df.groupBy(*keys).agg(*aggs)
    return per_file.select(*[F.col(f"_{name}").alias(name) for name in _FILE], F.inline(F.array(*entries)))


def refresh(spark: SparkSession, source: str, store: str, log_buckets: int = LOG_BUCKETS) -> int:
    """Sketch the files of the Parquet table ``source`` that ``store`` does not know; returns how many.

    A file counts as known with the same name, time and size. A refresh that dies leaves nothing, or
    a whole new part; one that is repeated finds the files known. Two refreshes at once may store a
    file twice, which the profile does not count twice. Columns that exist only in folder names are
    not part of a file and have no profile. The names of new files pass the driver, as in any scan.
    """
    listed = _files(spark, source)
    known = _stored(spark, store).select(*_FILE).distinct()
    new = [r["path"] for r in listed.join(known, [*_FILE], "left_anti").select("path").collect()]
    if not new:
        return 0
    sketches = sketch_rows(spark.read.parquet(*new), log_buckets)
    sketches.write.parquet(f"{store}/{uuid.uuid4().hex}")
    return len(new)


def profile(spark: SparkSession, source: str, store: str) -> DataFrame:
    """(position, column_name, column_type, n_rows, n_values, approx_distinct) of the table as it is now.

    Files that are gone, or were written again, no longer count. A file without rows has no sketch; a
    table without rows has no profile. A column with NULL only has 0 distinct values.
    """
    now = _files(spark, source)
    stored = _stored(spark, store).dropDuplicates([*_FILE, "position"])
    current = stored.join(now, [*_FILE], "left_semi")
    merged = current.groupBy("position", "column_name", "column_type").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"),
    )
    return merged
