"""Tables laid out for later readers: page directories, column sketches, co-located pairs."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, bag
from weakflow.functions.text import tokenize
from weakflow.operators import colocated, tokens
from weakflow.operators.corpus import _vendor_links, join_vendors
from weakflow.operators.ranks import global_rank
from weakflow.sources import directory, sketches


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_pages_of_a_directory_equal_a_sort(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    stored = directory.write_directory(df, ["l_orderkey", "l_linenumber"], str(tmp_path / "d"), rows_per_file=200)
    want = [tuple(r) for r in df.orderBy("l_orderkey", "l_linenumber", "l_quantity").collect()]
    assert stored.count() == len(want) and stored.files.count() > 10
    for offset, limit in [(0, 10), (195, 10), (1000, 700), (len(want) - 3, 10), (10**9, 5), (5, 0)]:
        got = [tuple(r) for r in stored.page(offset, limit).collect()]
        assert [g[:2] for g in got] == [w[:2] for w in want[offset : offset + limit]]
        assert len(stored.page(offset, limit).inputFiles()) == stored.files_of(offset, limit).count()
    # A page no longer than a file reaches two files at most, wherever it starts.
    assert all(stored.files_of(o, 20).count() <= 2 for o in range(0, len(want), 911))
    for at in (0, 199, 2000, len(want) - 1):
        for limit in (1, 250):
            got = [tuple(r)[:2] for r in stored.after(want[at][:2], limit).collect()]
            assert got == [w[:2] for w in want if w[:2] > want[at][:2]][:limit]
    assert [tuple(r)[:2] for r in stored.after(None, 2).collect()] == [w[:2] for w in want[:2]]
    again = directory.open_directory(spark, str(tmp_path / "d"))
    assert again.page(300, 9).collect() == stored.page(300, 9).collect() and again.columns == df.columns


def test_directory_with_nulls_repeats_and_without_rows(spark, tmp_path):
    rows = [(None, i) for i in range(5)] + [("same", i) for i in range(40)] + [("", 1), ("z", 2)]
    df = spark.createDataFrame(rows, "`a key` string, v int")
    stored = directory.write_directory(df, ["a key"], str(tmp_path / "n"), rows_per_file=7)
    keys = [r[0] for r in stored.page(0, 100).collect()]
    assert keys == [None] * 5 + [""] + ["same"] * 40 + ["z"]
    paged = [tuple(r) for o in range(0, 50, 6) for r in stored.page(o, 6).collect()]
    assert sorted(paged, key=repr) == sorted(rows, key=repr)  # repeated keys: each row on one page
    assert [r[0] for r in stored.after((None,), 3).collect()] == ["", "same", "same"]
    assert [r[0] for r in stored.after(("same",), 3).collect()] == ["z"]
    assert stored.after(("z",), 3).collect() == []
    empty = directory.write_directory(df.limit(0), ["a key"], str(tmp_path / "e"))
    assert empty.count() == 0 and empty.page(0, 5).collect() == [] and empty.after(("x",), 5).collect() == []
    with pytest.raises(ValueError):
        directory.write_directory(df.withColumn("_place", F.lit(1)), ["v"], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        stored.after(("a", "b"), 1)
    df.write.parquet(str(tmp_path / "half" / "rows"))  # rows without a directory are never served
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        directory.open_directory(spark, str(tmp_path / "half"))


def test_sketched_profile_is_close_to_exact_on_every_column(spark, tmp_path):
    source, store = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    df = df.withColumns({"blank": F.when(F.col("l_linenumber") == 1, ""), "nothing": F.lit(None).cast("string")})
    df.filter("l_orderkey % 3 = 0").write.parquet(source)
    first = sketches.refresh(spark, source, store)
    assert first > 0 and sketches.refresh(spark, source, store) == 0
    df.filter("l_orderkey % 3 <> 0").write.mode("append").parquet(source)
    assert sketches.refresh(spark, source, store) > 0
    exact = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first()
    values = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    got = sketches.profile(spark, source, store).orderBy("position").collect()
    assert [r.column_name for r in got] == df.columns
    for r in got:
        assert r.n_rows == df.count() and r.n_values == values[r.column_name]
        assert abs(r.approx_distinct - exact[r.column_name]) <= 0.02 * exact[r.column_name]


def test_sketches_of_files_that_are_gone_no_longer_count(spark, tmp_path):
    source, store = str(tmp_path / "t u"), str(tmp_path / "s")
    kinds = "n int, t string, at timestamp, m map<string,int>, a array<int>"
    rows = [(i, str(i % 7), datetime.datetime(2024, 1, 1 + i % 3), {"a": i % 2}, [i % 5]) for i in range(60)]
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(source)
    old = [f for f in os.listdir(source) if f.endswith(".parquet")]
    sketches.refresh(spark, source, store)
    spark.createDataFrame(rows[:10], kinds).coalesce(1).write.mode("append").parquet(source)
    sketches.refresh(spark, source, store)
    sketches.sketch_rows(spark.read.parquet(source)).write.parquet(f"{store}/twice")  # stored twice, counted once
    got = {r.column_name: (r.n_rows, r.approx_distinct) for r in sketches.profile(spark, source, store).collect()}
    assert got == {"n": (70, 60), "t": (70, 7), "at": (70, 3), "m": (70, 2), "a": (70, 5)}
    os.remove(f"{source}/{old[0]}")
    got = {r.column_name: (r.n_rows, r.approx_distinct) for r in sketches.profile(spark, source, store).collect()}
    assert got["n"] == (10, 10) and got["t"] == (10, 7)


def test_colocated_pair_joins_without_an_exchange(spark, tmp_path):
    left = spark.createDataFrame(
        [("hot", i) for i in range(40)]
        + [("both", i) for i in range(30)]
        + [("big", 7), ("big", 7), ("cold", 1), ("lonely", 2), ("", 3)]
        + [(None, i) for i in range(20)],
        "k string, a int",
    )
    right = spark.createDataFrame(
        [("big", f"b{i}") for i in range(50)]
        + [("both", f"x{i}") for i in range(25)]
        + [("hot", "h"), ("cold", "c"), ("cold", "c"), (None, "n"), ("", "e")],
        "k string, b string",
    )
    want = bag(left.join(right, "k", "left"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot_rows in (1, 7, 1000):
            path = str(tmp_path / f"p{hot_rows}")
            pair = colocated.colocate(left, right, "k", f"pair{hot_rows}", path, 4, hot_rows)
            assert bag(pair.join()) == want and exchanges(pair.join()) == 0
            served = colocated.attach(spark, f"served{hot_rows}", path, "k", 4)
            assert bag(served.join().select(*pair.columns)) == want and exchanges(served.join()) == 0
        none = colocated.colocate(left, right.limit(0), "k", "pairempty", str(tmp_path / "e"), 4)
        assert bag(none.join()) == bag(left.withColumn("b", F.lit(None).cast("string")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError, match="columns on both sides"):
        colocated.colocate(left, right.withColumnRenamed("b", "a"), "k", "bad", str(tmp_path / "b"))
    with pytest.raises(ValueError, match="int on the right"):
        colocated.colocate(left, right.withColumn("k", F.lit(1)), "k", "bad", str(tmp_path / "b"))


def test_vendors_that_are_not_small_are_joined_with_hot_keys_split(spark):
    rows = [(f"p{i}", "hot") for i in range(60)] + [(f"q{i}", None) for i in range(30)] + [("r", "cold"), ("s", "lost")]
    vp = spark.createDataFrame(rows, "product string, vendor string")
    vendors = spark.createDataFrame([("hot",), ("hot",), ("cold",), ("other",), (None,)], "vendor string")
    want = bag(vp.join(vendors, "vendor", "left").select("vendor", "product"))
    for hot_rows in (3, 1000):
        assert bag(join_vendors(vp, vendors, max_bytes=0, hot_rows=hot_rows)) == want
        links = _vendor_links(vp, vendors, False, max_bytes=0, hot_rows=hot_rows)
        assert bag(links) == bag(_vendor_links(vp, vendors, False))


def test_global_rank_in_one_exchange(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    vocab = tokens.vocabulary(tokens.word_counts(docs, "doc_id"))
    assert dict(vocab.dtypes)["idx"] == "bigint"
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("v"), F.lit("x").alias("_range_of"))
    ranked = global_rank(df.repartition(7), [F.desc("v")], "place")
    assert bag(ranked.select("v", "place")) == sorted([(v, 1000 - v) for v in range(1000)], key=repr)
    # Only the sum over ranges is shuffled after the rows were stored; the rows are not.
    assert "Window" in ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_directory_computes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(n):
        made.add(1)
        return n * 7 % 1000

    rows = spark.range(1000).repartition(4).select(F.udf(counted, "long")("id").alias("k"))
    stored = directory.write_directory(rows, ["k"], str(tmp_path / "once"))
    assert [r.k for r in stored.page(500, 3).collect()] == [500, 501, 502]
    assert made.value == 1000
