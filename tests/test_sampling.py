import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import bag
from weakflow.operators import labels, sampling


def md5_hash(key, seed):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds most rows, one has a single row.
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("k"),
        F.expr("CASE WHEN id < 2000 THEN 'big' WHEN id < 2999 THEN concat('m', id % 7) ELSE 'one' END").alias("y"),
    )
    return df.cache()


def test_sampling_fractions(spark):
    counts = spark.createDataFrame(
        [("a", 1), ("b", 299), ("c", 300), ("d", 999), ("e", 1000)], "cwe_name string, n long"
    )
    got = {r.cwe_name: r.fraction for r in sampling.label_fractions(counts).collect()}
    assert got == {"a": 0.01, "b": 0.01, "c": 0.01, "d": 3 / 999, "e": 0.002}
    floor = {r.cwe_name: r.fraction for r in sampling.label_fractions(counts, min_rows=5).collect()}
    assert floor["a"] == 1.0 and floor["b"] == 5 / 299


def test_samples_do_not_depend_on_partitioning(rows):
    key = F.col("k")
    want = {r.k for r in rows.collect() if md5_hash(r.k, 42) < 0.1 * 2**32}
    fractions = rows.groupBy("y").agg(F.lit(0.5).alias("fraction")).filter("y <> 'm1'")
    stratified = None
    for n in (1, 7, 64):
        part = rows.repartition(n)
        assert {r.k for r in sampling.sample_rows(part, key, 0.1).collect()} == want
        got = bag(sampling.sample_stratified(part, fractions, key, "y"))
        assert stratified in (None, got)
        stratified = got
    assert not [r for r in stratified if r[1] == "m1"]


def test_cap_takes_the_lowest_hashes(rows):
    want = sorted((md5_hash(r.k, 42), r.k) for r in rows.collect())
    for n in (0, 1, 500, 3000, 9999):
        got = {r.k for r in sampling.cap_rows(rows, n, F.col("k")).collect()}
        assert got == {k for _, k in want[:n]}


def test_exact_split(rows):
    for n in (1, 16):
        got = sampling.split_rows_exact(rows.repartition(n), F.col("k")).collect()
        want = sorted((md5_hash(r.k, "split"), r.k) for r in got)[: int(3000 * 0.8)]
        assert {r.k for r in got if r.part == "train"} == {k for _, k in want}
        assert len(got) == 3000


def test_stratified_split_has_exact_sizes(rows):
    got = sampling.split_stratified(rows, F.col("k"), "y").collect()
    test = [r for r in got if r.part == "test"]
    assert len(got) == 3000 and len(test) == math.ceil(0.2 * 3000)
    by_class = {}
    for r in got:
        by_class.setdefault(r.y, []).append(r)
    for members in by_class.values():
        chosen = {r.k for r in members if r.part == "test"}
        assert abs(len(chosen) - 0.2 * len(members)) < 1
        lowest = sorted(members, key=lambda r: (md5_hash(r.k, "split"), r.k))[: len(chosen)]
        assert chosen == {r.k for r in lowest}


def test_random_splits_are_complete(rows):
    parts = {r.part: r.n for r in sampling.split_rows(rows, F.col("k")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 3000 and 2250 < parts["train"] < 2550
    three = sampling.split_three(rows, F.col("k")).groupBy("part").count().collect()
    assert {r.part for r in three} == {"train", "valid", "test"}
    assert sum(r["count"] for r in three) == 3000
    order = [r.k for r in sampling.training_order(rows.repartition(5), F.col("k")).collect()]
    assert order == sorted(order, key=lambda k: md5_hash(k, "order"))


def test_labels(spark, rows):
    dictionary = [tuple(r) for r in labels.label_dictionary(rows, "y").orderBy("idx").collect()]
    assert dictionary[0] == ("big", 0) and [i for _, i in dictionary] == list(range(9))
    kept, final = labels.drop_rare_labels(rows.withColumnRenamed("y", "name"), "name")
    assert kept.count() == 2999 and final.count() == 8
    coded = {(r.name, r.y) for r in kept.select("name", "y").distinct().collect()}
    assert coded == {(r.label, r.idx) for r in final.collect()}
    names = {r.label: r.idx for r in final.collect()}
    assert "one" not in names and sorted(names.values()) == list(range(8))
    counts = labels.label_counts(rows, "y")
    weights = {r.y: r.weight for r in labels.class_weights(counts, "y").collect()}
    assert weights["one"] == pytest.approx(3000 / (9 * 1))
    assert weights["big"] == pytest.approx(3000 / (9 * 2000))


def test_exact_sizes_come_from_the_stored_rows(rows, monkeypatch):
    stored = []
    stage = sampling.stage
    monkeypatch.setattr(sampling, "stage", lambda df, name: stored.append((name, df.columns)) or stage(df, name))
    # Each time the rows are made anew, others are left; the split must be of those that were stored.
    some = rows.select("k", F.rand().alias("r")).filter("r < 0.5").select("k")
    parts = sampling.split_rows_exact(some, F.col("k")).groupBy("part").count().collect()
    n = {r["part"]: r["count"] for r in parts}
    assert n["train"] == math.floor(sum(n.values()) * 0.8)
    assert dict(stored)["hashed"] == ["k", "_all", "_hash", "_no"]
