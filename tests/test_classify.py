import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, bag
from weakflow.functions.text import tokenize
from weakflow.operators import classify, reports, rules, tokens
from weakflow.plans import fixtures as fx
from weakflow.sources import artefacts
from weakflow.sources.staging import stage
from weakflow.streaming import page_stream


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(0, 0, [2, 3, 2]), (1, 0, [3]), (2, 1, [4, 4, 1]), (3, 2, [2, 4])]
    df = spark.createDataFrame(rows, "doc_id long, y int, ids array<int>")
    names = [(" A", 0), (" B", 1), (" C", 2), (" never seen", 3)]
    dictionary = spark.createDataFrame(names, "label string, idx int")
    return rows, df, dictionary


def test_naive_bayes_matches_python(tiny):
    rows, df, dictionary = tiny
    model = classify.store(classify.train_naive_bayes(df, dictionary, num_words=5))
    got = {r.doc_id: [s.score for s in r.scores] for r in classify.score(df, model).collect()}
    for doc, _, ids in rows:
        for y in range(3):
            mine = [r for r in rows if r[1] == y]
            n = sum(len(r[2]) for r in mine)
            want = round(math.log(len(mine) / 4) * 1e6) + len(ids) * round(math.log(1 / (n + 5)) * 1e6)
            for i in ids:
                want += round(math.log(1 + sum(r[2].count(i) for r in mine)) * 1e6)
            assert got[doc][y] == want
        assert got[doc][3] < min(got[doc][:3]) - 10_000_000


def test_scoring_and_encoding_by_small_slices(spark, tiny, monkeypatch):
    """Slices that cut texts, skip empty ones and end in the middle of a batch add up to the same."""
    _, _, dictionary = tiny
    odd = [(0, [2, 3, 2, 4, 9]), (1, []), (2, None), (3, [3]), (4, [4] * 11), (5, []), (6, [1, 2])]
    more = spark.createDataFrame(odd, "doc_id long, ids array<int>").coalesce(1)
    model = classify.store(classify.train_naive_bayes(tiny[1], dictionary, num_words=5))
    want = bag(classify.score_by_join(more, model).select("doc_id", "scores"))
    vocab = spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "word string, n long, idx long")
    texts = [(0, ["a", "x", "b", "a"]), (1, []), (2, None), (3, ["b"]), (4, ["a", None, "a"])]
    texts = spark.createDataFrame(texts, "doc_id long, tokens array<string>").coalesce(1)
    coded = bag(tokens.encode_sequences(texts, vocab).select("doc_id", "ids"))
    monkeypatch.setattr(tokens, "_LOOKED_UP", 3)
    assert bag(tokens.encode_sequences(texts, vocab).select("doc_id", "ids")) == coded
    assert [r[1] for r in coded] == [[2, 1, 3, 2], [], [], [3], [2, 1, 2]]
    for gathered in (4, 12, 20):  # four classes: one, three and five words at a time
        monkeypatch.setattr(classify, "_GATHERED", gathered)
        assert bag(classify.score_by_lookup(more, model).select("doc_id", "scores")) == want


def test_both_ways_of_scoring_agree(spark, tiny):
    """Also for repeated and NULL ids, NULL and empty texts, and classes without rows or weight."""
    _, df, _ = tiny
    weights = spark.createDataFrame([(" A", 0.5), (" B", 2.0)], "label string, weight double")
    names = [(" A", 0), (" AA", 4), (" B", 1), (" C", 2), (" never seen", 7)]  # gaps in the index
    dictionary = spark.createDataFrame(names, "label string, idx int")
    model = classify.store(classify.train_naive_bayes(df, dictionary, 5, weights=weights))
    more = df.union(
        spark.createDataFrame([(9, 0, []), (10, 0, [77, 1]), (11, 0, None), (10, 1, [3]), (None, 1, [3])], df.schema)
    )
    a = classify.score_by_lookup(more, model).select("doc_id", "scores")
    b = classify.score_by_join(more, model).select("doc_id", "scores")
    assert bag(a) == bag(b)
    assert all([s.y for s in r.scores] == [0, 1, 2, 4, 7] for r in a.collect())


def test_classes_without_training_rows_keep_their_index(spark):
    rows = [(i, y, [2 + y] * 4) for i, y in enumerate([0, 0, 2, 2, 4, 4])]
    df = spark.createDataFrame(rows, "doc_id long, y int, ids array<int>")
    names = [(f" L{y}", y) for y in range(6)]  # 1, 3 and the last have no rows
    dictionary = spark.createDataFrame(names, "label string, idx int")
    weights = spark.createDataFrame([(" L0", 1.0), (" L2", 1.0), (" L4", 1.0)], "label string, weight double")
    model = classify.store(classify.train_naive_bayes(df, dictionary, 8, weights=weights))
    for scored in (classify.score_by_lookup(df, model), classify.score_by_join(df, model)):
        predicted = classify.predict(classify.probabilities(scored), dictionary)
        assert all(r.y_pred == r.y and r.label == f"L{r.y}" for r in predicted.collect())
        assert classify.log_loss(predicted).first().log_loss < 1


def test_scoring_memory_is_bounded(spark):
    """67 classes and a batch of 10,000 rows; the sums of one batch would take 1.6 GB at once."""
    classes = spark.range(67).selectExpr("CAST(id AS INT) AS y", "concat('c', id) AS label", "0L AS prior", "-1L AS base")
    cells = spark.range(67).selectExpr("CAST(id AS INT) AS y", "CAST(id + 2 AS INT) AS idx", "1000L AS delta")
    model = classify.store(classify.NaiveBayes(classes, cells))
    df = spark.range(10_000, numPartitions=1).selectExpr("id", "transform(sequence(1, 300), i -> CAST(id % 67 + 2 AS INT)) AS ids")
    best = F.expr("array_max(transform(scores, s -> struct(s.score, s.y)))")
    scored = classify.score(df, model).select("id", best.alias("best"))
    wrong = scored.filter("best.y <> id % 67 OR best.score <> 300 * 999")
    assert wrong.isEmpty()


def test_predictions_break_ties_by_index_and_name_unknown_classes(spark):
    df = spark.createDataFrame(
        [(1, [(0, 5), (1, 9), (2, 9), (3, 1)], [1]), (2, [(0, 3)], [1])],
        "doc_id long, scores array<struct<y:int,score:long>>, ids array<int>",
    )
    names = spark.createDataFrame([(" A", 0), (" B", 1)], "label string, idx int")
    got = {r.doc_id: r for r in classify.predict(classify.probabilities(df), names).collect()}
    assert [t.label for t in got[1].top] == ["B", "Class_2", "A"] and got[1].label == "B"
    assert sum(got[1].probs) == pytest.approx(1) and got[1].probs[1] == got[1].probs[2]
    assert [t.label for t in got[2].top] == ["A"] and got[2].confidence == 1.0
    unknown = classify.predict(classify.probabilities(df), names.filter("idx = 0"))
    assert {r.doc_id: r.label for r in unknown.collect()} == {1: "Unknown", 2: "A"}


def test_risk_bounds(spark):
    given = [0.29, 0.3, 0.59, 0.6, 0.79, 0.8]
    df = spark.createDataFrame([(c,) for c in given], "c double")
    level = rules.risk_level(F.col("c"))
    got = [tuple(r) for r in df.select(level, rules.risk_colour(level)).collect()]
    assert [g[0] for g in got] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert [g[1] for g in got] == ["green", "orange", "orange", "red", "red", "darkred"]


def test_feature_text_and_recommendations(spark):
    df = spark.createDataFrame([("domain x path / query ", "", "server nginx", "form get /")], "url_analysis string, content string, headers string, forms string")
    text = df.select(rules.with_keywords(rules.named_features(("url_analysis", "content")))).first()[0]
    assert text == "url_analysis domain x path / query  file inclusion vulnerability"

    def advice(label):
        column = rules.recommendations(F.lit(""), F.col("headers"), F.col("forms"), F.lit(label))
        return df.select(column).first()[0]

    assert advice("x") == [rules.ADVICE_SECURITY_HEADERS, rules.ADVICE_SERVER, rules.ADVICE_FORMS]
    sql = advice("SQL Injection and Access")
    assert len(sql) == 5 and sql[3:] == list(rules.LABEL_ADVICE[0][1][:2])


@pytest.fixture(scope="module")
def trained(spark):
    docs = fx.labelled_documents(spark, SF).withColumn("tokens", tokenize(F.col("text")))
    vocab = stage(tokens.vocabulary(tokens.word_counts(docs, "doc_id")))
    names = docs.select("label").distinct().orderBy("label").collect()
    dictionary = spark.createDataFrame(
        [(r.label, i) for i, r in enumerate(names)], "label string, idx int"
    )
    coded = docs.join(dictionary.withColumnRenamed("idx", "y"), "label")
    encoded = tokens.encode_sequences(coded, vocab, num_words=500)
    model = classify.store(classify.train_naive_bayes(encoded, dictionary, 500))
    return vocab, dictionary, model, encoded


def test_training_separates_the_classes(trained):
    _, dictionary, model, encoded = trained
    scored = classify.probabilities(classify.score(encoded.drop("label"), model))
    predicted = classify.predict(scored, dictionary)
    # A tenth of the labels follow the source, not the text, so some predictions must be wrong;
    # saturated scores then cost much, and the tempered ones of the queries little.
    assert 0.75 < classify.accuracy(predicted).first().accuracy < 1
    tempered = classify.log_loss(classify.probabilities(scored.drop("probs"), "length")).first().log_loss
    assert tempered < math.log(6)  # the loss of a uniform guess among the six classes
    assert tempered < classify.log_loss(predicted).first().log_loss
    assert classify.confusion(predicted).agg(F.sum("n")).first()[0] == encoded.count()


def test_artefacts_round_trip(spark, trained, tmp_path):
    vocab, dictionary, model, _ = trained
    artefacts.save_model(model, vocab, dictionary, str(tmp_path / "m"))
    model2, vocab2, names, meta = artefacts.load_model(spark, str(tmp_path / "m"))
    assert bag(model2.cells) == bag(model.cells) and bag(vocab2) == bag(vocab)
    assert bag(model2.classes.select(*model.classes.columns)) == bag(model.classes)
    assert bag(names) == bag(dictionary.select(F.trim("label"), "idx"))
    assert meta.first().num_classes == 6 and meta.first().max_len == 300
    lines = spark.createDataFrame([(" a: b ('c'):12",), ("no index",)], "value string")
    assert bag(artefacts.parse_label_lines(lines)) == [("a: b ('c')", 12)]


def test_regression_round_trip(spark, trained, tmp_path):
    vocab, _, _, encoded = trained
    counter, lr = classify.train_logistic_regression(encoded.withColumn("w", F.lit(1.0)), vocab, "w", 5, 500)
    artefacts.save_regression(counter, lr, str(tmp_path / "lr"))
    counter2, lr2 = artefacts.load_regression(str(tmp_path / "lr"))
    a = lr.transform(counter.transform(encoded)).select("doc_id", "prediction")
    b = lr2.transform(counter2.transform(encoded)).select("doc_id", "prediction")
    assert bag(a) == bag(b)


def test_stream_and_reports_equal_batch(spark, trained, tmp_path):
    vocab, dictionary, model, _ = trained
    site = fx.site_pages(spark, SF)
    batch = reports.analyze_pages(site, vocab, model, dictionary, F.lit("2025-01-01").cast("timestamp"))
    site.repartition(3).write.parquet(str(tmp_path / "in"))
    pages = page_stream.read_page_stream(spark, str(tmp_path / "in"), 1)
    query = page_stream.start_page_analysis(
        pages, vocab, model, dictionary, str(tmp_path / "out"), str(tmp_path / "ck")
    )
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = spark.read.parquet(str(tmp_path / "out"))
    same = ["page_id", "predicted_vulnerability", "confidence", "risk_level", "recommendations", "links"]
    assert bag(streamed.select(*same)) == bag(batch.select(*same))

    reports.write_reports(batch, str(tmp_path / "reports"))
    main = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "reports/main"))
    # The twelve report columns, the domain, and the bucket of the folder.
    assert main.count() == site.count() and len(main.columns) == 14
    n = batch.agg(F.sum(F.size("recommendations"))).first()[0]
    recs = spark.read.option("header", True).csv(str(tmp_path / "reports/recommendations"))
    assert recs.count() == n
    features = reports.features_report(batch)
    assert features.count() == 8 * site.count()
    assert features.filter("Content = ''").count() == 0
    assert reports.top_report(batch).filter("Rank > 3").count() == 0
