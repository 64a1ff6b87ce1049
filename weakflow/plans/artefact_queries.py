"""Queries over stored artefacts and sinks: written, read back, and compared whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.functions.text import tokenize
from weakflow.operators import classify, colocated, corpus, labels, reports, sampling, tokens
from weakflow.plans import classify_queries as cq
from weakflow.plans import corpus_queries as rq
from weakflow.plans import fixtures as fx
from weakflow.plans.registry import Registry
from weakflow.sources import artefacts, directory, sketches, tables
from weakflow.sources.staging import new_path, stage

registry = Registry()


@registry.add(
    "scan_csv_untyped",
    f"""WITH {fx.SQL_DIMENSIONS}
SELECT cve_id, vulnerable_product, count(*) AS n FROM products GROUP BY ALL""",
)
def scan_csv_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with another delimiter and no schema: every column is a string."""
    path = new_path(spark, "products-untyped")
    fx.products(spark, sf_dir).write.option("header", True).option("delimiter", ";").csv(path)
    df = tables.read_csv(spark, path, delimiter=";")
    return df.groupBy("cve_id", "vulnerable_product").agg(F.count(F.lit(1)).alias("n"))


@registry.add("vocabulary_roundtrip", f"{cq._SQL_WORDS} SELECT word, n, CAST(idx AS BIGINT) AS idx FROM vocab")
def vocabulary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocabulary")
    artefacts.save_vocabulary(cq.vocabulary(spark, sf_dir), path)
    return artefacts.load_vocabulary(spark, path)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page analysis from a model that was stored and loaded."""
    t = cq._trained(spark, sf_dir)
    path = new_path(spark, "model")
    artefacts.save_model(t.model, t.vocab, t.dictionary, path)
    model, vocab, names, _ = artefacts.load_model(spark, path)
    at = F.lit(cq._AT).cast("timestamp")
    return reports.analyze_pages(fx.site_pages(spark, sf_dir), vocab, model, names, at)


@registry.add(
    "model_roundtrip_analyze",
    f"""{cq._SQL_ANALYSIS} SELECT page_id, predicted AS predicted_vulnerability,
  {cq._r6('confidence')} AS confidence, array_to_string(labels3, '; ') AS top_labels FROM analysis""",
)
def model_roundtrip_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir).select(
        "page_id",
        "predicted_vulnerability",
        cq._rounded(F.col("confidence")).alias("confidence"),
        F.array_join(F.transform("top_3_predictions", lambda t: t["label"]), "; ").alias("top_labels"),
    )


def _report(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder = new_path(spark, "reports")
    reports.write_reports(cq._analysis(spark, sf_dir), folder)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    # An empty text is written in quotes and NULL without; any other mark for NULL keeps them apart.
    reader = reader.option("nullValue", "\\N")
    return reader.csv(f"{folder}/{name}")


@registry.add(
    "report_csv_main",
    f"""{cq._SQL_ANALYSIS} SELECT url AS "URL", '{cq._AT}' AS "Analysis_Timestamp", risk_level AS "Risk_Level",
  predicted AS "Predicted_Vulnerability", printf('%.4f', confidence) AS "Confidence",
  labels3[1] || printf(' (%.3f)', probs3[1]) AS "Top_Prediction_1",
  labels3[2] || printf(' (%.3f)', probs3[2]) AS "Top_Prediction_2",
  labels3[3] || printf(' (%.3f)', probs3[3]) AS "Top_Prediction_3",
  CASE WHEN security_headers <> '' THEN 'true' ELSE 'false' END AS "Security_Headers_Present",
  technologies AS "Technologies_Detected", CASE WHEN forms <> '' THEN 'true' ELSE 'false' END AS "Forms_Found",
  CAST(len(advice) AS VARCHAR) AS "Recommendations_Count",
  replace(replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '_'), ':', '_') AS domain FROM analysis""",
)
def report_csv_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve report columns and the domain, as they come back from the files."""
    return _report(spark, sf_dir, "main").drop("bucket")


@registry.add(
    "report_csv_recommendations",
    f"""{cq._SQL_ANALYSIS} SELECT CAST(page_id AS VARCHAR) AS page_id, url,
  CAST(generate_subscripts(advice, 1) AS VARCHAR) AS "Rank", unnest(advice) AS "Recommendation" FROM analysis""",
)
def report_csv_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "recommendations")


@registry.add(
    "report_csv_features",
    f"{cq._SQL_ANALYSIS} "
    + " UNION ALL ".join(
        f"""SELECT CAST(page_id AS VARCHAR) AS page_id, '{f}' AS "Feature_Type",
  md5(CASE WHEN {f} = '' THEN 'None' ELSE left({f}, 500) END) AS "Content" FROM analysis"""
        for f in cq.FEATURES
    ),
)
def report_csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _report(spark, sf_dir, "features")
    return read.select("page_id", "Feature_Type", F.md5("Content").alias("Content"))


_ORDER = fx.sql_hash("CAST(doc_id AS VARCHAR)", "order")


@registry.add(
    "training_order",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}, CAST(doc_id AS VARCHAR)) AS place FROM documents""",
)
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the repeatable shuffled order."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.training_order(docs, F.col("doc_id").cast("string"))


# --- the whole job: corpus -> sample -> classifier -> evaluation ---------------------------

_ROWS_OF_CLASS = 40  # rows that a small class keeps in the sample, so that it can be tested
_SQL_JOB = f"""{fx.SQL_KEYED},
counts AS (SELECT cwe_name, count(*) AS n FROM corpus GROUP BY cwe_name),
shares AS (SELECT cwe_name, least(1.0, greatest({rq._SQL_FRACTION},
    CAST({_ROWS_OF_CLASS} AS DOUBLE) / n)) AS fraction FROM counts),
sampled AS (SELECT k.* FROM keyed k JOIN shares s ON s.cwe_name = k.cwe_name
  WHERE {fx.sql_hash("k.row_key")} < s.fraction * CAST(4294967296.0 AS DOUBLE)),
labelled AS (SELECT row_key AS doc_id, cwe_name AS label, text FROM sampled)"""
_SQL_JOB_SCORED = cq._SQL_SCORED.replace(f"WITH {fx.SQL_LABELLED}", _SQL_JOB).replace(
    "min(doc_id * 1000000 + pos) AS first", "min({'d': doc_id, 'p': pos}) AS first"
)


@registry.add(
    "corpus_train_eval",
    f"""{_SQL_JOB_SCORED}, tested AS (SELECT s.doc_id, s.label, p.label AS predicted FROM split s
  JOIN probs p ON p.doc_id = s.doc_id AND p.r = 1 WHERE s.part = 'test')
SELECT trim(label) AS label, trim(predicted) AS predicted, count(*) AS n,
  (SELECT count(*) FROM tested) AS n_test,
  (SELECT {cq._r6('avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END)')} FROM tested) AS accuracy
FROM tested GROUP BY label, predicted""",
)
def corpus_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified sample, text, tokens, rare classes out, split, weights, training, confusion."""
    source = corpus.Corpus(*fx.corpus_tables(spark, sf_dir))
    counts = stage(source.label_counts(), "label-counts")
    fractions = sampling.label_fractions(counts, min_rows=_ROWS_OF_CLASS)
    sample = stage(sampling.sample_stratified(source.keys(), fractions, corpus.row_key()), "sample")
    rows = source.attach_text(sample)
    tokenized = rows.select(
        corpus.row_key().alias("doc_id"), F.col("cwe_name").alias("label"), tokenize(F.col("text")).alias("tokens")
    )
    tokenized = stage(tokenized, "tokenized")
    vocab = stage(tokens.vocabulary(tokens.word_counts(tokenized, "doc_id")), "vocabulary")
    encoded = tokens.drop_empty_sequences(tokens.encode_sequences(tokenized, vocab).drop("tokens"))
    coded, dictionary = labels.drop_rare_labels(stage(encoded, "encoded"), "label")
    parts = sampling.split_stratified(coded, F.col("doc_id"), "label")
    split = stage(parts, "split")
    train = split.filter("part = 'train'")
    weights = labels.class_weights(labels.label_counts(train, "label"), "label")
    model = classify.store(classify.train_naive_bayes(train, dictionary, weights=weights))
    test = split.filter("part = 'test'").withColumnRenamed("label", "true_label")
    scored = classify.probabilities(classify.score(test, model), "length")
    predicted = stage(classify.predict(scored, dictionary).select("true_label", "label", "y", "y_pred"), "predicted")
    of_test = classify.accuracy(predicted)
    return (
        predicted.groupBy(F.trim("true_label").alias("label"), F.col("label").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_test", of_test.select("n").scalar())
        .withColumn("accuracy", of_test.select(cq._rounded(F.col("accuracy"))).scalar())
    )


# --- tables laid out for later readers ------------------------------------------------------


def _keyed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.Corpus(*fx.corpus_tables(spark, sf_dir)).keys()
    return rows.select(corpus.row_key().alias("row_key"), "cwe_name")


@registry.add(
    "page_directory",
    f"""{fx.SQL_KEYED} SELECT row_key, cwe_name FROM keyed
ORDER BY row_key LIMIT 5000 OFFSET 5000""",
)
def page_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page at an offset, read from the files that hold it."""
    keyed = _keyed_labels(spark, sf_dir)
    stored = directory.write_directory(keyed, ["row_key"], new_path(spark, "directory"), rows_per_file=10_000)
    return stored.page(5000, 5000)


@registry.add(
    "page_directory_after",
    f"""{fx.SQL_KEYED} SELECT row_key, cwe_name FROM keyed WHERE row_key > 'CVE-5'
ORDER BY row_key LIMIT 5000""",
)
def page_directory_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed_labels(spark, sf_dir)
    stored = directory.write_directory(keyed, ["row_key"], new_path(spark, "directory"), rows_per_file=10_000)
    return stored.after(("CVE-5",), 5000)


@registry.add(
    "profile_sketches",
    f"""WITH {fx.SQL_DIMENSIONS}
SELECT CAST(0 AS INT) AS position, 'cve_id' AS column_name, 'string' AS column_type,
  count(*) AS n_rows, count(cve_id) AS n_values, true AS close FROM products
UNION ALL SELECT 1, 'vulnerable_product', 'string', count(*), count(vulnerable_product), true FROM products""",
)
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a table that arrived in two deliveries, each sketched once. ``close``: the
    estimate of distinct values is within 2 percent of the exact count."""
    products = fx.products(spark, sf_dir)
    source, store = new_path(spark, "delivered"), new_path(spark, "sketches")
    late = F.coalesce(F.col("vulnerable_product").endswith("7"), F.lit(False))
    for part in (products.filter(~late), products.filter(late)):
        part.write.mode("append").parquet(source)
        sketches.refresh(spark, source, store)
    whole = spark.read.parquet(source)
    exact = whole.agg(*[F.countDistinct(c).alias(c) for c in whole.columns])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in whole.columns])))
    found = sketches.profile(spark, source, store).join(exact, "column_name")
    error = F.abs(F.col("approx_distinct") - F.col("exact"))
    return found.select(
        "position", "column_name", "column_type", "n_rows", "n_values", (error <= 0.02 * F.col("exact")).alias("close")
    )


def _colocated(spark: SparkSession, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    path = new_path(spark, "colocated")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    return colocated.colocate(left, right, key, name, path).join()


@registry.add("join_colocated_products", rq.registry.oracles["join_cve_products"])
def join_colocated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVE left join products from tables stored in the same buckets."""
    cve = fx.cve(spark, sf_dir).select("cve_id", "cwe_name")
    return _colocated(spark, cve, fx.products(spark, sf_dir), "cve_id")


@registry.add("join_colocated_vendors", rq.registry.oracles["join_product_vendor"])
def join_colocated_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products left join vendor_product from tables stored in the same buckets."""
    # The pair is stored with exact copies counted, so the joined rows are distinct and need no exchange.
    left = corpus.count_copies(fx.products(spark, sf_dir), "_left_copies")
    right = corpus.count_copies(fx.vendor_product(spark, sf_dir), "_right_copies")
    left = left.withColumn("_product", F.col("vulnerable_product"))
    rows = _colocated(spark, left, right.withColumn("_product", F.col("product")), "_product")
    return rows.select(
        "cve_id", "vulnerable_product", "product", "vendor", corpus.joined_copies("_left_copies", "_right_copies").alias("n")
    )
