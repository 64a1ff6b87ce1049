"""Joins prepared once: both sides stored in the same buckets, so later joins need no shuffle.

A pair of tables that is joined again and again (CVE with products, products with vendors) is written
bucketed by its key. The keys that are hot when the pair is written are cut into parts as in
``spread_left_join``, and the part belongs to the bucketing, so that a hot key is spread over buckets.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.operators.joins import HOT_ROWS, cut_sides, hot_keys, join_cut_sides, key_sizes

BUCKETS = 64
_PARTS = ("_lpart", "_rpart")
_OWN = (*_PARTS, "_lparts", "_rparts", "_matched")


@dataclass(frozen=True)
class Colocated:
    """A stored pair, read without an exchange."""

    spark: SparkSession
    name: str
    key: str
    columns: tuple[str, ...]

    def sides(self) -> tuple[DataFrame, DataFrame]:
        return self.spark.table(f"`{self.name}_left`"), self.spark.table(f"`{self.name}_right`")

    def join(self) -> DataFrame:
        """``left LEFT JOIN right USING (key)`` of the rows that were stored."""
        return join_cut_sides(*self.sides(), self.key).select(*[F.col(f"`{c}`") for c in self.columns])


def _write(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    by = [key, *_PARTS]
    # Dealt out by the expression of the buckets, so a bucket is one file.
    dealt = df.repartition(buckets, *[F.col(f"`{c}`") for c in by])
    writer = dealt.write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
    writer.option("path", path).saveAsTable(table)


def colocate(
    left: DataFrame,
    right: DataFrame,
    key: str,
    name: str,
    path: str,
    buckets: int = BUCKETS,
    hot_rows: int = HOT_ROWS,
) -> Colocated:
    """Store both sides under ``path`` as tables ``{name}_left`` and ``{name}_right`` of the session.

    Keys must have one type on both sides; a cast would hide the buckets. NULL keys on the left match
    nothing and are dealt out over all buckets; on the right they are left out. Choose ``buckets`` so
    that one fits a task. The tables must not exist yet; names hold letters, digits and ``_``.
    """
    kinds = [df.schema[key].dataType for df in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"{key} is {kinds[0].simpleString()} on the left, {kinds[1].simpleString()} on the right")
    taken = sorted({*left.columns, *right.columns} & {*_OWN})
    twice = sorted({*left.columns} & {*right.columns} - {key})
    if taken or twice:
        raise ValueError(f"columns used by the join itself: {taken}; columns on both sides: {twice}")
    named, known = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    hot = hot_keys(key_sizes(named, key), key_sizes(known, key), key, hot_rows)
    cut_left, cut_right = cut_sides(named, known, key, hot)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(buckets * 16)).cast("int")
    unnamed = left.filter(F.col(key).isNull()).withColumns(
        {"_lpart": spread, "_rpart": F.lit(0), "_rparts": F.lit(1)}
    )
    _write(cut_left.unionByName(unnamed), f"{name}_left", f"{path}/left", key, buckets)
    _write(cut_right, f"{name}_right", f"{path}/right", key, buckets)
    columns = (key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key])
    return Colocated(left.sparkSession, name, key, columns)


def attach(spark: SparkSession, name: str, path: str, key: str, buckets: int = BUCKETS) -> Colocated:
    """A pair that another application stored under ``path``, with the key and number of buckets it chose."""
    columns: list[str] = [key]
    for side in ("left", "right"):
        schema = spark.read.parquet(f"{path}/{side}").schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{c}`" for c in (key, *_PARTS))
        place = f"{path}/{side}".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE `{name}_{side}` ({fields}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        columns += [f.name for f in schema if f.name not in _OWN and f.name != key]
    return Colocated(spark, name, key, tuple(columns))
