import os
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF, bag
from weakflow import schemas
from weakflow.operators.corpus import (
    Corpus,
    corpus_text,
    count_copies,
    join_vendor_products,
    join_vendors,
    joined_copies,
    keep_labelled,
)
from weakflow.operators.joins import expand_copies, hot_keys, spread_left_join
from weakflow.plans import catalog
from weakflow.sources import staging, tables
from weakflow.sources.staging import stage


def small_tables(spark):
    cve = spark.createDataFrame(
        [
            ("c1", " A", "sum one"),
            ("c2", " B", None),
            ("c3", None, "no label"),
            ("c4", " A", None),
        ],
        "cve_id string, cwe_name string, summary string",
    )
    products = spark.createDataFrame(
        [("c1", "p1")] * 3 + [("c1", "p2"), ("c1", None), ("c2", "p1"), ("c2", "p9"), ("c9", "p1")],
        schemas.PRODUCTS,
    )
    vendor_product = spark.createDataFrame(
        [("v1", "p1"), ("v1", "p1"), ("v2", "p1"), ("v3", "p2"), (None, "p2"), ("v4", "p7")],
        schemas.VENDOR_PRODUCT,
    )
    vendors = spark.createDataFrame([("v1",), ("v1",), ("v2",)], schemas.VENDORS)
    return cve, products, vendor_product, vendors


def plain_join(cve, products, vp, vendors):
    rows = cve.join(products, "cve_id", "left")
    rows = rows.join(vp, rows.vulnerable_product == vp.product, "left")
    rows = rows.join(vendors, "vendor", "left").withColumn("text", corpus_text())
    return keep_labelled(rows).select("cve_id", "vulnerable_product", "vendor", "cwe_name", "text")


def test_corpus_equals_plain_joins(spark):
    source = small_tables(spark)
    want = bag(plain_join(*source))
    for hot_rows in (1, 2, 1000):
        got = Corpus(*source, hot_rows=hot_rows).rows()
        assert bag(got.select("cve_id", "vulnerable_product", "vendor", "cwe_name", "text")) == want
    # c1 names p1 three times; v1 lists p1 twice and is listed twice: 3 * 2 * 2 copies.
    copies = Counter(r[:3] for r in want)
    assert copies[("c1", "p1", "v1")] == 12
    keys = Corpus(*source).keys().select("cve_id", "vulnerable_product", "vendor", "copy_no")
    assert keys.count() == keys.distinct().count() == len(want)


def test_text_is_attached_to_every_sampled_row(spark):
    """NULL and repeated CVE ids, exact copies of a CVE, empty next to NULL names."""
    cve, products, vp, vendors = small_tables(spark)
    more = [("c1", " A", "second text"), ("c1", " A", "second text"), (None, " B", "no id"), (None, " B", "none"), ("", " B", "")]
    cve = cve.union(spark.createDataFrame(more, cve.schema))
    products = products.union(spark.createDataFrame([(None, "p1"), ("", "p2"), ("c1", "")], products.schema))
    source = Corpus(cve, products, vp, vendors)
    want = bag(source.rows().select("cve_id", "vulnerable_product", "vendor", "text"))
    sample = stage(source.keys())
    got = bag(source.attach_text(sample).select("cve_id", "vulnerable_product", "vendor", "text"))
    assert got == want and sample.count() == len(want)
    assert want == bag(plain_join(cve, products, vp, vendors).select("cve_id", "vulnerable_product", "vendor", "text"))


def test_hot_keys_are_those_with_many_rows_or_many_pairs(spark):
    left = spark.createDataFrame([("a", 30), ("b", 4), ("c", 8), ("d", 1)], "k string, n long")
    right = spark.createDataFrame([("a", 1), ("b", 25), ("c", 9), ("e", 99)], "k string, n long")
    got = {r.k: (r.lparts, r.rparts) for r in hot_keys(left, right, "k", 10).collect()}
    assert got == {"a": (3, 1), "b": (1, 3)}
    pair = spark.createDataFrame([("c", 90), ("d", 5)], "k string, n long")
    many = {r.k: (r.lparts, r.rparts) for r in hot_keys(pair, pair, "k", 100).collect()}
    assert many == {"c": (9, 1)}  # 8,100 pairs of a key that is hot on neither side


def test_label_counts_equal_counting_the_rows(spark):
    source = small_tables(spark)
    rows = Corpus(*source).rows()
    assert bag(Corpus(*source).label_counts()) == bag(
        rows.groupBy("cwe_name").agg(F.count(F.lit(1)))
    )
    assert bag(Corpus(*source).label_counts("cve")) == [(" A", 2), (" B", 1)]


def test_blank_text_is_kept_unless_asked(spark):
    source = small_tables(spark)
    assert ("c4", "  ") in bag(Corpus(*source).rows().select("cve_id", "text"))
    assert "c4" not in [r[0] for r in bag(Corpus(*source).rows(drop_blank=True).select("cve_id"))]


def test_vendor_column_comes_first_and_unique_vendors_skip_the_join(spark):
    _, _, vp, vendors = small_tables(spark)
    assert join_vendors(vp.select("product", "vendor"), vendors).columns == ["vendor", "product"]
    assert join_vendors(vp, vendors.distinct(), unique=True).count() == vp.count()


def test_spread_join_equals_left_join(spark):
    left = spark.createDataFrame(
        [("hot", i) for i in range(40)]
        + [("both", i) for i in range(30)]
        + [("cold", 1), ("lonely", 2)]
        + [(None, i) for i in range(20)],
        "k string, a int",
    )
    right = spark.createDataFrame(
        [("big", f"b{i}") for i in range(50)]
        + [("both", f"x{i}") for i in range(25)]
        + [("hot", "h"), ("cold", "c"), ("cold", "c"), (None, "n")],
        "k string, b string",
    )
    left = left.union(spark.createDataFrame([("big", 7), ("big", 7)], "k string, a int"))
    want = bag(left.join(right, "k", "left"))
    for hot_rows in (1, 3, 10):
        assert bag(spread_left_join(left, right, "k", hot_rows=hot_rows)) == want


def test_expand_copies_in_pieces(spark):
    df = spark.createDataFrame([("a", 1), ("b", 25)], "k string, n long")
    got = expand_copies(df, "n", "i", chunk=10)
    assert bag(got) == [("a", 0)] + sorted([("b", i) for i in range(25)], key=repr)


def test_blank_csv_header_is_repaired(spark, tmp_path):
    (tmp_path / "cve.csv").write_text(',cwe_name,summary\nCVE-1, A,"one, two ""q"""\n')
    df = tables.repair_header(tables.read_csv(spark, str(tmp_path / "cve.csv")))
    assert df.columns == ["cve_id", "cwe_name", "summary"]
    assert df.first()["summary"] == 'one, two "q"'
    assert dict(df.dtypes)["cve_id"] == "string"
    # An explicit schema also keeps numeric-looking names as text.
    (tmp_path / "vendors.csv").write_text("vendor\n3456\n")
    got = tables.read_csv(spark, str(tmp_path / "vendors.csv"), schemas.VENDORS)
    assert got.first()["vendor"] == "3456"
    inferred = tables.read_csv(spark, str(tmp_path / "vendors.csv"), infer=True)
    assert dict(inferred.dtypes)["vendor"] == "int"


def test_parquet_and_paging(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    tables.write_parquet(df, str(tmp_path / "t"))
    tables.write_parquet(df, str(tmp_path / "t"))
    stored = tables.read_parquet(spark, str(tmp_path / "t"), ["id"])
    assert stored.columns == ["id"] and stored.count() == 100
    assert [r.id for r in tables.page_rows(stored, ["id"], 10, 5).collect()] == [10, 11, 12, 13, 14]
    assert [r.id for r in tables.page_after(stored, "id", 14, 3).collect()] == [15, 16, 17]
    assert [r.id for r in tables.page_after(stored, "id", None, 2).collect()] == [0, 1]
    assert sum(1 for _ in tables.iterate_rows(stored)) == 100
    profile = tables.profile_columns(df, approx_distinct=True).orderBy("position").collect()
    assert [(r.column_name, r.column_type, r.n_rows) for r in profile] == [
        ("id", "bigint", 100),
        ("x", "bigint", 100),
    ]


def test_staged_tables_can_be_dropped(spark):
    df = stage(spark.range(5), "dropped")
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 5
    made, staging._made[:] = staging._made[:], [m for m in staging._made if "dropped-" in m]
    staging.drop_staged(spark)
    staging._made[:] = made  # other tests still read theirs
    assert not os.path.exists(path)


def test_vendor_joins_have_no_shuffle_above_the_fan_out(spark):
    """Copies are counted before the join, so its rows are not gathered again."""
    for name in ("join_product_vendor", "join_colocated_vendors"):
        found = catalog.queries()[name](spark, SF)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Join ")]
        assert "Aggregate" not in above, name


def test_counted_copies_join_like_the_rows(spark):
    _, products, vp, _ = small_tables(spark)
    vp = vp.union(spark.createDataFrame([("v9", None), (None, "p2")], vp.schema))
    want = products.join(vp, products.vulnerable_product == vp.product, "left")
    want = want.groupBy("cve_id", "vulnerable_product", "product", "vendor").agg(F.count(F.lit(1)).alias("n"))
    got = join_vendor_products(count_copies(products, "_l"), count_copies(vp, "_r"))
    got = got.select("cve_id", "vulnerable_product", "product", "vendor", joined_copies("_l", "_r").alias("n"))
    assert bag(got) == bag(want)


def test_pairs_hold_only_products_that_labelled_cves_name(spark):
    """The vendors of other products join with nothing, so they are not counted or stored."""
    source = Corpus(*small_tables(spark))
    assert {r["product"] for r in source.pairs.collect()} == {"p1", "p2"}  # p7 is not named
    assert bag(source.vendor_sizes) == [("p1", 2, 5), ("p2", 2, 2)]


def test_text_length_needs_no_text(spark):
    cve, *rest = small_tables(spark)
    odd = [("c5", " A", "  "), ("c6", " B", "h\u00e9 \U0001f600"), (None, " B", "no id")]
    source = Corpus(cve.union(spark.createDataFrame(odd, cve.schema)), *rest)
    rows = source.rows()
    assert rows.filter(F.col("text_length") != F.length("text")).count() == 0
    blank = bag(source.rows().filter(F.trim("text") == "").select("cve_id"))
    whole, kept = bag(rows.select("cve_id")), bag(source.rows(drop_blank=True).select("cve_id"))
    assert {("c4",), ("c5",)} == set(blank) and sorted(kept + blank, key=repr) == whole
    counted = source.rows(drop_blank=True).groupBy("cwe_name").agg(F.sum("text_length"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "summary" not in plan[: plan.index("Join ")].replace("summary_length", "").replace("summary_blank", "")


def test_assembly_does_not_sort_the_fan_out(spark):
    found = catalog.queries()["corpus_assemble"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("MapInArrow")
    assert "SortAggregate" not in plan[plan.index("MapInArrow") :]


def test_shared_prefixes_are_stored_once(spark):
    path = staging.new_path(spark, "prefixes")
    noise = "".join(str(hash((i, "x")) % 10**9) for i in range(2000))
    rows = spark.range(0, 2000, 1, 1).select(F.concat(F.lit(noise), F.col("id").cast("string")).alias("text"))
    tables.write_parquet(rows, path, shared_prefixes=True)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    assert size < 10 * len(noise)
    assert bag(tables.read_parquet(spark, path)) == bag(rows)
