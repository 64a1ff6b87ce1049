"""Models trained once and served many times: versioned folders with a manifest written last.

A version is a folder of tables that nobody changes once it is published. Its manifest names it, and
appears only when Spark commits the write of it, after all tables; readers look at manifests alone, so
a version that a lost job left half written is never served. The manifest also holds what the tables
must look like. Loading compares: the schemas, the row counts, and a fingerprint of the classes and of
the label dictionary, which a model must never be separated from.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.operators.classify import NaiveBayes

TABLES = {
    "classes": "y int, label string, prior long, base long",
    "cells": "y int, idx int, delta long",
    "vocabulary": "word string, n long, idx long",
    "labels": "label string, idx int",
}
_CHECKED_WHOLE = ("classes", "labels")  # one row per class; the others are counted
_MANIFEST = "number long, version string, schemas map<string,string>, rows map<string,long>, prints map<string,string>, facts map<string,string>"


@dataclass(frozen=True)
class Served:
    number: int
    version: str
    model: NaiveBayes
    vocab: DataFrame
    labels: DataFrame
    facts: dict[str, str]


def _fingerprint(table: DataFrame) -> str:
    """The same for equal rows in any order and partitioning."""
    row = F.xxhash64(*table.columns)
    found = table.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return "/".join(str(x) for x in found)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per published version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{root}/manifests/*")


def publish(
    spark: SparkSession,
    root: str,
    model: NaiveBayes,
    vocab: DataFrame,
    labels: DataFrame,
    facts: dict[str, str] | None = None,
) -> str:
    """Write a new version and make it the latest; returns its name. ``facts`` go along as they are.

    Two publishers at once get different names, and both versions stay whole; the one with the greater
    name is then the latest.
    """
    latest = manifests(spark, root).agg(F.max("number")).first()[0]
    number = (latest or 0) + 1
    version = f"{number:08d}-{uuid.uuid4().hex}"
    given = {"classes": model.classes, "cells": model.cells, "vocabulary": vocab, "labels": labels}
    rows, prints = {}, {}
    for name, ddl in TABLES.items():
        path = f"{root}/versions/{version}/{name}"
        wanted = [c.split()[0] for c in ddl.split(", ")]
        given[name].select(*wanted).to(spark.createDataFrame([], ddl).schema).write.parquet(path)
        written = spark.read.schema(ddl).parquet(path)
        rows[name] = written.count()
        if name in _CHECKED_WHOLE:
            prints[name] = _fingerprint(written)
    manifest = spark.createDataFrame([(number, version, TABLES, rows, prints, facts or {})], _MANIFEST)
    manifest.coalesce(1).write.json(f"{root}/manifests/{version}")
    return version


def load(spark: SparkSession, root: str, version: str | None = None) -> Served:
    """The latest published version, or the named one, after its tables were checked."""
    known = manifests(spark, root)
    if version is not None:
        known = known.filter(F.col("version") == version)
    found = known.orderBy(F.desc("number"), F.desc("version")).first()
    if found is None:
        raise LookupError(f"no published model in {root}" + (f" with version {version}" if version else ""))
    tables = {}
    for name, ddl in TABLES.items():
        if found["schemas"].get(name) != ddl:
            raise ValueError(f"model {found['version']}: {name} was written as {found['schemas'].get(name)}")
        table = spark.read.schema(ddl).parquet(f"{root}/versions/{found['version']}/{name}")
        whole = name in _CHECKED_WHOLE
        if table.count() != found["rows"][name] or (whole and _fingerprint(table) != found["prints"][name]):
            raise ValueError(f"model {found['version']}: {name} is not what was published")
        tables[name] = table
    model = NaiveBayes(tables["classes"], tables["cells"])
    return Served(found["number"], found["version"], model, tables["vocabulary"], tables["labels"], found["facts"])
