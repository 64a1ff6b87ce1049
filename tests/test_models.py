"""Whole-corpus statistics, best classes, calibration, the model store, and exact selection."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import bag
from weakflow.functions.text import tokenize
from weakflow.operators import calibration, classify, factorised, observed, sampling, topk
from weakflow.operators.corpus import Corpus
from weakflow.operators.labels import class_weights
from weakflow.sources import model_store


@pytest.fixture(scope="module")
def odd_corpus(spark):
    """Repeated and NULL ids, names without words, vendors listed twice, products without vendors."""
    rng = random.Random(8)
    labels = ["a", "b", "c", None]
    cve = [(f"C{i % 40}", rng.choice(labels), rng.choice([None, "", "!!", "Buffer overflow in x", f"word{i % 7} twice twice"])) for i in range(60)]
    cve += [(None, "a", "no id here"), (None, "b", "--"), ("C1", "a", "same"), ("C1", "a", "same"), ("only", "rare", "once")]
    products = [(f"C{rng.randint(0, 45)}", rng.choice([None, "p one", "p-two", "...", "lonely", ""])) for _ in range(150)] + [("C3", "p one")] * 30
    pairs = [(rng.choice(["v1", "V two", "++", None]), rng.choice(["p one", "p-two", "...", "other", ""])) for _ in range(25)]
    vendors = [("v1",), ("v1",), ("V two",), ("++",), (None,)]
    tables = [
        spark.createDataFrame(cve, "cve_id string, cwe_name string, summary string"),
        spark.createDataFrame(products, "cve_id string, vulnerable_product string"),
        spark.createDataFrame(pairs, "vendor string, product string"),
        spark.createDataFrame(vendors, "vendor string"),
    ]
    return Corpus(*tables, hot_rows=20)


def test_statistics_equal_those_of_the_joined_rows(odd_corpus):
    statistics = factorised.CorpusStatistics(odd_corpus)
    rows = odd_corpus.rows().select("cwe_name", tokenize(F.col("text")).alias("tokens")).cache()
    words = rows.select("cwe_name", F.explode("tokens").alias("word"))
    assert bag(statistics.counts) == bag(words.groupBy("cwe_name", "word").count())
    assert bag(statistics.word_counts()) == bag(words.groupBy("word").count())
    sizes = rows.groupBy("cwe_name").agg(F.count(F.lit(1)), F.count_if(F.size("tokens") > 0))
    assert bag(statistics.classes) == bag(sizes)
    numbered = statistics.vocabulary().orderBy("idx").collect()
    assert [r.idx for r in numbered] == list(range(2, len(numbered) + 2))
    assert numbered == sorted(numbered, key=lambda r: (-r.n, r.word))


def test_whole_word_counts_take_no_label_along(odd_corpus):
    """Nothing is grouped by label, and the counts are those by label, added up."""
    statistics = factorised.CorpusStatistics(odd_corpus)
    whole = statistics.word_counts()
    assert not re.search(r"Aggregate \[[^\]]*cwe_name", whole._jdf.queryExecution().optimizedPlan().toString())
    assert "counts" not in vars(statistics) and "mentions" not in vars(statistics)
    assert bag(whole) == bag(statistics.counts.groupBy("word").agg(F.sum("n").alias("n")))


def test_whole_corpus_model_equals_training_on_its_rows(odd_corpus):
    """The same model as one trained row by row, also with words beyond ``num_words``."""
    statistics = factorised.CorpusStatistics(odd_corpus)
    model, vocab, dictionary = statistics.naive_bayes(num_words=6)
    rows = odd_corpus.rows().select("cwe_name", tokenize(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    index = {r.word: r.idx if r.idx < 6 else 1 for r in vocab.collect()}
    y = {r.label: r.idx for r in dictionary.collect()}
    coded = [(y[r.cwe_name], [index[w] for w in r.tokens]) for r in rows.collect() if r.cwe_name in y]
    assert "rare" not in y
    df = odd_corpus.cve.sparkSession.createDataFrame(coded, "y int, ids array<int>")
    names = dictionary.select(F.col("idx").alias("y"), "label")
    counts = df.join(names, "y").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    slow = classify.train_naive_bayes(df, dictionary, num_words=6, weights=class_weights(counts, "label"))
    assert bag(model.classes.select("y", "label", "prior", "base")) == bag(slow.classes.select("y", "label", "prior", "base"))
    assert bag(model.cells.select("y", "idx", "delta")) == bag(slow.cells.select("y", "idx", "delta"))


def test_training_reads_the_ids_of_its_rows_once(spark):
    """Class sizes come from the counted words; rows without a word count as rows."""
    rows = [(0, [2, 3, 3]), (0, []), (1, [3]), (1, None), (2, [])]
    df = spark.createDataFrame(rows, "y int, ids array<int>")
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "label string, idx int")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def read(ids):
        reads.add(1)
        return ids

    model = classify.train_naive_bayes(df.withColumn("ids", read.asNondeterministic()("ids")), names, num_words=4)
    found = {r.y: (r.prior, r.base) for r in model.classes.collect()}
    base = [round(float(np.log(1 / (n + 4))) * 1e6) for n in (3, 1, 0, 0)]
    prior = [round(float(np.log(n / 5)) * 1e6) if n else classify.NO_ROWS_PRIOR for n in (2, 2, 1, 0)]
    assert found == dict(enumerate(zip(prior, base)))
    assert bag(model.cells.select("y", "idx")) == [(0, 2), (0, 3), (1, 3)]
    assert reads.value == len(rows)


def test_statistics_make_no_row_per_corpus_row(spark):
    """One CVE with 200 mentions of a product with 300 vendors is 60,000 corpus rows; no step makes them."""
    cve = spark.createDataFrame([("C", "a", "one two")], "cve_id string, cwe_name string, summary string")
    products = spark.createDataFrame([("C", f"p{i}") for i in range(200)], "cve_id string, vulnerable_product string")
    pairs = spark.range(200).join(spark.range(300).withColumnRenamed("id", "v")).selectExpr("concat('v', v) AS vendor", "concat('p', id) AS product")
    vendors = spark.createDataFrame([("v1",)], "vendor string")
    statistics = factorised.CorpusStatistics(Corpus(cve, products, pairs, vendors))
    found = {r.word: r.n for r in statistics.word_counts().collect()}
    assert found["one"] == 60_000 and found["p7"] == 300 and found["v7"] == 200
    assert statistics.summaries.count() == 1 and statistics.mentions.count() == 200


def many_classes(classes, words, seed=3):
    rng = np.random.default_rng(seed)
    prior = -rng.integers(5_000_000, 12_000_000, classes)
    base = -rng.integers(9_000_000, 9_500_000, classes)
    y = rng.integers(0, classes, words * 400)
    idx = rng.integers(0, words, words * 400)
    keys = np.unique(idx * classes + y)
    delta = rng.integers(1, 4, len(keys)) * 700_000
    return prior, base, keys // classes, keys % classes, delta


def dense_best(prior, base, idx, y, delta, ids, top):
    value = prior + len(ids) * base
    for word in ids:
        of_word = idx == word
        value[y[of_word]] += delta[of_word]
    order = np.lexsort((np.arange(len(value)), -value))[:top]
    return [(int(value[k]), int(k)) for k in order]


def test_best_of_100_000_classes_without_scoring_them_all():
    prior, base, idx, y, delta = many_classes(100_000, 300)
    classes = pa.table({"y": np.arange(100_000, dtype=np.int32), "prior": prior, "base": base})
    shard = topk.shard_of(classes, pa.table({"y": y.astype(np.int32), "idx": idx.astype(np.int32), "delta": delta}))
    rng = np.random.default_rng(5)
    looked = []
    for size in (0, 1, 2, 5, 9, 40):
        for _ in range(6):
            ids = rng.integers(0, 310, size)
            found, scored = shard.best(ids, 3)
            assert found == dense_best(prior, base, idx, y, delta, ids, 3)
            looked.append(scored)
    assert np.mean(looked) < 20_000


def test_best_classes_of_a_table_and_of_a_stream(spark, tmp_path):
    prior, base, idx, y, delta = many_classes(500, 20)
    model = classify.NaiveBayes(
        spark.createDataFrame(list(zip(range(500), map(str, range(500)), prior.tolist(), base.tolist())), "y int, label string, prior long, base long"),
        spark.createDataFrame(list(zip(y.tolist(), idx.tolist(), delta.tolist())), "y int, idx int, delta long"),
    )
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 25) for _ in range(rng.randint(0, 12))]) for i in range(40)] + [(40, None), (40, [])]
    table = spark.createDataFrame(rows, "id long, ids array<int>")
    want = sorted((i, dense_best(prior, base, idx, y, delta, ids or [], 3)) for i, ids in rows)
    for shard_cells in (4_000_000, 900):
        got = topk.top_classes(table, model, 3, shard_cells).collect()
        assert sorted((r.id, [(b.score, b.y) for b in r.best]) for r in got) == want
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    scored = topk.top_classes(stream, model, 3, 900)
    query = scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, [(b.score, b.y) for b in r.best]) for r in got) == want


def scored_rows(spark, rows):
    table = [([(k, int(s)) for k, s in enumerate(scores)], [0] * size, y) for scores, size, y in rows]
    return spark.createDataFrame(table, "scores array<struct<y:int,score:long>>, ids array<int>, y int")


def test_sharpness_is_where_the_loss_is_least(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        size, y = rng.randint(1, 30), rng.randint(0, 2)
        scores = [rng.gauss(0, 1) + (0.7 if k == y else 0) for k in range(3)]
        rows.append(([s * size * 1e6 for s in scores], size, y))
    table = scored_rows(spark, rows)

    def loss(sharpness):
        return classify.log_loss(calibration.calibrated(table, sharpness)).first()["log_loss"]

    best = calibration.fit_sharpness(table)
    assert 0.1 < best < 10
    assert loss(best) <= min(loss(1.0), loss(best * 1.05), loss(best / 1.05)) + 1e-12


def test_sharpness_of_odd_tables(spark):
    assert calibration.fit_sharpness(scored_rows(spark, [([1.0, 2.0], 3, 9)])) == 1.0  # a class without a score
    assert calibration.fit_sharpness(scored_rows(spark, [([2e6, 1e6], 1, 0)] * 3)) > 10  # always right
    assert calibration.fit_sharpness(scored_rows(spark, [([2e6, 1e6], 1, 1)] * 3)) < 0.1  # always wrong
    bins = calibration.reliability(spark.createDataFrame([(1.0, 1, 1), (0.95, 1, 2), (0.05, 0, None)], "confidence double, y int, y_pred int"))
    assert bag(bins.select("bin", "n", "correct")) == [(0, 1, 0), (9, 2, 1)]


def small_model(spark):
    classes = spark.createDataFrame([(0, "x", -5, -7), (1, "y:z", -6, -8)], "y int, label string, prior long, base long")
    cells = spark.createDataFrame([(0, 2, 3), (1, 3, 4)], "y int, idx int, delta long")
    vocab = spark.createDataFrame([("w", 5, 2), ("v", 4, 3)], "word string, n long, idx int")
    return classify.NaiveBayes(classes, cells), vocab, spark.createDataFrame([("x", 0), ("y:z", 1)], "label string, idx int")


def test_model_versions(spark, tmp_path):
    root = str(tmp_path / "models")
    with pytest.raises(LookupError):
        model_store.load(spark, root)
    model, vocab, names = small_model(spark)
    first = model_store.publish(spark, root, model, vocab, names, {"sharpness": "0.5"})
    served = model_store.load(spark, root)
    assert (served.version, served.number, served.facts) == (first, 1, {"sharpness": "0.5"})
    assert bag(served.model.cells) == bag(model.cells) and bag(served.labels) == bag(names)
    second = model_store.publish(spark, root, model, vocab.limit(1), names)
    assert model_store.load(spark, root).version == second and model_store.load(spark, root, first).vocab.count() == 2
    with pytest.raises(LookupError):
        model_store.load(spark, root, "00000009-none")


def test_half_written_and_changed_versions_are_not_served(spark, tmp_path):
    root = str(tmp_path / "models")
    model, vocab, names = small_model(spark)
    good = model_store.publish(spark, root, model, vocab, names)
    # A job lost before its manifest was committed: tables, and a manifest that is still temporary.
    model.classes.write.parquet(f"{root}/versions/00000002-lost/classes")
    (tmp_path / "models/manifests/00000002-lost/_temporary/0").mkdir(parents=True)
    (tmp_path / "models/manifests/00000002-lost/_temporary/0/part-0.json").write_text('{"number": 2, "version": "00000002-lost"}')
    assert model_store.load(spark, root).version == good
    swapped = names.select(F.when(F.col("idx") == 0, "y:z").otherwise("x").alias("label"), "idx")
    swapped.write.mode("overwrite").parquet(f"{root}/versions/{good}/labels")
    with pytest.raises(ValueError, match="labels"):
        model_store.load(spark, root)


def test_selection_is_exact_with_repeated_and_missing_keys(spark):
    keys = ["same"] * 500 + [f"k{i}" for i in range(40)] + [None] * 60
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long").repartition(4)
    for n in (0, 1, 2, 77, 333, 599, 600, 700):
        assert sampling.cap_rows(rows, n, F.col("k")).count() == min(n, 600)
    labelled = rows.withColumn("y", F.when(F.col("i") % 2 == 0, "a"))
    parts = sampling.split_stratified(labelled, F.col("k"), "y").groupBy("y", "part").count()
    assert bag(parts) == bag(spark.createDataFrame([("a", "test", 60), ("a", "train", 240), (None, "test", 60), (None, "train", 240)]))


def test_training_order_numbers_every_row_once(spark):
    rows = spark.createDataFrame([(k,) for k in ["a", "b", "a", None, "c", None]], "k string")
    placed = sampling.training_order(rows, F.col("k")).orderBy("place").collect()
    assert [r.place for r in placed] == [1, 2, 3, 4, 5, 6]
    again = sampling.training_order(rows.repartition(3), F.col("k")).orderBy("place").collect()
    assert [r.k for r in placed] == [r.k for r in again]


def test_drop_report(spark):
    rows = [("w one", "a"), ("x", "a"), ("y", None), (" ", "a"), (None, "b"), ("!!", "b"), ("once", "c"), (None, None)]
    table = spark.createDataFrame(rows, "text string, label string")
    kept, report = observed.drop_report(table, "text", "label", tokenize(F.col("text")))
    assert dict(report.collect()) == {"rows": 8, "unlabelled": 2, "blank": 2, "empty": 1, "rare": 1, "kept": 2}
    assert bag(kept.select("text", "tokens")) == bag(spark.createDataFrame([("w one", ["w", "one"]), ("x", ["x"])]))
    _, report = observed.drop_report(table.filter("false"), "text", "label", tokenize(F.col("text")))
    assert {r.n for r in report.collect()} == {0}
