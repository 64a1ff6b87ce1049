"""Queries over the classifier: tokens, vocabulary, training, scoring, evaluation, reports."""

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.functions.text import WORD_SEPARATORS, one_hot, tokenize
from weakflow.operators import (
    calibration,
    classify,
    corpus,
    factorised,
    labels,
    reports,
    rules,
    sampling,
    tokens,
    topk,
)
from weakflow.plans import fixtures as fx
from weakflow.plans.page_queries import SQL_TEXT, sql_recommendations
from weakflow.plans.registry import Registry
from weakflow.schemas import FEATURES
from weakflow.sources import model_store
from weakflow.sources.staging import shared_folder, stage

registry = Registry()
LR_FLOOR = 0.7  # share of right predictions that the regression must reach


def _rounded(x: Column, places: int = 6) -> Column:
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def _r6(x: str) -> str:
    return f"floor({x} * 1e6 + 0.5) / 1e6"


def _joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


# The SQL below types out report columns, levels and texts again: fixed values.
# --- SQL fragments ---------------------------------------------------------------------


def _sql_tokens(text: str) -> str:
    blanks = " " * len(WORD_SEPARATORS)
    return (
        f"list_filter(string_split(translate(lower({text}), {fx.quote(WORD_SEPARATORS)}, "
        f"'{blanks}'), ' '), lambda w: w <> '')"
    )


_SQL_WORDS = f"""WITH {fx.SQL_LABELLED},
tokenized AS (SELECT doc_id, label, {_sql_tokens("text")} AS tokens FROM labelled),
words AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos
  FROM tokenized),
counted AS (SELECT word, count(*) AS n, min(doc_id * 1000000 + pos) AS first FROM words GROUP BY word),
vocab AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, first) + 1 AS INT) AS idx
  FROM counted)"""

_SQL_CODED = f"""{_SQL_WORDS},
coded AS (SELECT w.doc_id, w.pos, coalesce(v.idx, 1) AS idx
  FROM words w LEFT JOIN vocab v ON v.word = w.word AND v.idx < 10000),
listed AS (SELECT t.doc_id, t.label, c.ids FROM tokenized t
  JOIN (SELECT doc_id, list(idx ORDER BY pos) AS ids FROM coded GROUP BY doc_id) c
    ON c.doc_id = t.doc_id)"""

_SQL_ENCODED = f"""{_SQL_CODED},
dict AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y
  FROM (SELECT label FROM listed GROUP BY label HAVING count(*) >= 2)),
encoded AS (SELECT l.doc_id, l.label, d.y, l.ids FROM listed l JOIN dict d ON d.label = l.label)"""

_SQL_SPLIT = f"""{_SQL_ENCODED},
class_sizes AS (SELECT label, count(*) AS c FROM encoded GROUP BY label),
totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, (CAST(sum(c) AS BIGINT) * 20 + 99) // 100 AS nt
  FROM class_sizes),
shared AS (SELECT label, nt, (nt * c) // n AS base, (nt * c) % n AS rest FROM class_sizes, totals),
quotas AS (SELECT label, base + CASE WHEN
    row_number() OVER (ORDER BY rest DESC, label) <= nt - sum(base) OVER () THEN 1 ELSE 0 END
    AS quota FROM shared),
split AS (SELECT e.*, CASE WHEN row_number() OVER (PARTITION BY e.label ORDER BY
    {fx.sql_hash("CAST(e.doc_id AS VARCHAR)", "split")}, CAST(e.doc_id AS VARCHAR)) <= q.quota
    THEN 'test' ELSE 'train' END AS part
  FROM encoded e JOIN quotas q ON q.label = e.label),
weights AS (SELECT label, count(*) AS n,
    CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
  FROM split WHERE part = 'train' GROUP BY label)"""

_SQL_MODEL = f"""{_SQL_SPLIT},
train_sizes AS (SELECT d.y, d.label, count(s.doc_id) AS docs, coalesce(sum(len(s.ids)), 0) AS tokens
  FROM dict d LEFT JOIN split s ON s.y = d.y AND s.part = 'train' GROUP BY d.y, d.label),
weighed AS (SELECT s.*, coalesce(w.weight, 1.0) AS weight
  FROM train_sizes s LEFT JOIN weights w ON w.label = s.label),
classes AS (SELECT y, label, CASE WHEN docs = 0 THEN -50000000 ELSE
    CAST(round(ln(docs * weight / (SELECT sum(docs * weight) FROM weighed)) * 1e6) AS BIGINT) END AS prior,
    CAST(round(ln(1.0 / (tokens * weight + 10000.0)) * 1e6) AS BIGINT) AS base, weight
  FROM weighed),
train_words AS (SELECT y, unnest(ids) AS idx FROM split WHERE part = 'train'),
cells AS (SELECT c.y, t.idx, CAST(round(ln(count(*) * any_value(c.weight) + 1) * 1e6) AS BIGINT)
    AS delta FROM train_words t JOIN classes c ON c.y = t.y GROUP BY c.y, t.idx)"""


def _sql_scores(source: str, doc: str) -> str:
    """CTEs: scores and probabilities of ``source`` (doc, ids) for each class."""
    return f"""
doc_words AS (SELECT {doc}, unnest(ids) AS idx FROM {source}),
sums AS (SELECT w.{doc}, c.y, sum(c.delta) AS s FROM doc_words w JOIN cells c ON c.idx = w.idx
  GROUP BY w.{doc}, c.y),
scored AS (SELECT e.{doc}, c.y, c.label, greatest(len(e.ids), 1) AS size,
    CAST(c.prior + len(e.ids) * c.base + coalesce(s.s, 0) AS BIGINT) AS score
  FROM {source} e CROSS JOIN classes c LEFT JOIN sums s ON s.{doc} = e.{doc} AND s.y = c.y),
shifted AS (SELECT *, exp((score - max(score) OVER (PARTITION BY {doc})) / CAST(1e6 AS DOUBLE) / size)
    AS w FROM scored),
probs AS (SELECT *, w / sum(w) OVER (PARTITION BY {doc}) AS prob,
    row_number() OVER (PARTITION BY {doc} ORDER BY score DESC, y) AS r FROM shifted)"""


_SQL_SCORED = f"{_SQL_MODEL},{_sql_scores('split', 'doc_id')}"


# --- shared steps ----------------------------------------------------------------------


def _tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.labelled_documents(spark, sf_dir)
    return docs.select("doc_id", "label", tokenize(F.col("text")).alias("tokens"))


def _vocabulary(tokenized: DataFrame) -> DataFrame:
    return stage(tokens.vocabulary(tokens.word_counts(tokenized, "doc_id")), "vocabulary")


def _encoded(tokenized: DataFrame, vocab: DataFrame) -> DataFrame:
    encoded = tokens.encode_sequences(tokenized, vocab).drop("tokens")
    return tokens.drop_empty_sequences(encoded)


@dataclass(frozen=True)
class _Trained:
    vocab: DataFrame
    dictionary: DataFrame
    rows: DataFrame  # doc_id, label, y, ids, part
    weights: DataFrame
    model: classify.NaiveBayes


def _split(
    spark: SparkSession, sf_dir: str, unseen: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary, dictionary, rows with y and part); ``unseen`` adds classes without rows."""
    tokenized = _tokenized(spark, sf_dir)
    vocab = _vocabulary(tokenized)
    encoded = stage(_encoded(tokenized, vocab), "encoded")
    coded, dictionary = labels.drop_rare_labels(encoded, "label")
    if unseen:
        more = spark.createDataFrame([(name,) for name in unseen], "label string")
        names = dictionary.select("label").unionByName(more)
        dictionary = stage(labels.label_dictionary(names, "label"), "dictionary")
        coded = labels.label_encode(coded.drop("y"), dictionary, "label")
    # The split works on keys; the token arrays are not stored a second time.
    keys = stage(coded.select("doc_id", "label"), "keys")
    parts = sampling.split_stratified(keys, F.col("doc_id").cast("string"), "label")
    return vocab, dictionary, coded.join(parts.select("doc_id", "part"), "doc_id")


def _trained(spark: SparkSession, sf_dir: str, unseen: tuple[str, ...] = ()) -> _Trained:
    vocab, dictionary, rows = _split(spark, sf_dir, unseen)
    train = rows.filter(F.col("part") == "train")
    weights = labels.class_weights(labels.label_counts(train, "label"), "label")
    model = classify.store(classify.train_naive_bayes(train, dictionary, weights=weights))
    return _Trained(vocab, dictionary, rows, weights, model)


def _names(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("idx", "label")


def _predicted(
    spark: SparkSession, sf_dir: str, part: str | None = None, unseen: tuple[str, ...] = ()
) -> DataFrame:
    t = _trained(spark, sf_dir, unseen)
    rows = t.rows.withColumnRenamed("label", "true_label")
    if part:
        rows = rows.filter(F.col("part") == part)
    scored = classify.probabilities(classify.score(rows, t.model), "length")
    return classify.predict(scored, _names(t.dictionary))


# --- tokens ----------------------------------------------------------------------------


@registry.add(
    "tokenize",
    f"""{_SQL_WORDS} SELECT doc_id, len(tokens) AS n_tokens,
  md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tokenized""",
)
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenized(spark, sf_dir).select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


@registry.add(
    "drop_empty_sequences",
    """SELECT count(*) AS n_docs, count(*) FILTER (cleaned = '') AS n_dropped,
  count(*) FILTER (cleaned <> '') AS n_kept
FROM (SELECT trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) AS cleaned FROM conversations)""",
)
def drop_empty_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that hold letters, and how many were dropped."""
    letters = F.regexp_replace("text", "[^a-zA-Z]+", " ")
    rows = fx.table(spark, sf_dir, "conversations").select(tokenize(letters).alias("tokens"))
    kept = tokens.drop_empty_sequences(rows, "tokens").agg(F.count(F.lit(1)))
    return rows.agg(F.count(F.lit(1)).alias("n_docs")).select(
        "n_docs",
        (F.col("n_docs") - kept.scalar()).alias("n_dropped"),
        kept.scalar().alias("n_kept"),
    )


@registry.add(
    "word_counts",
    f"""{_SQL_WORDS} SELECT word, n, first // 1000000 AS first_doc,
  CAST(first % 1000000 AS INT) AS first_pos FROM counted""",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.word_counts(_tokenized(spark, sf_dir), "doc_id")


@registry.add("vocabulary", f"{_SQL_WORDS} SELECT word, n, CAST(idx AS BIGINT) AS idx FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(tokens.word_counts(_tokenized(spark, sf_dir), "doc_id"))


@registry.add(
    "encode_sequences",
    f"{_SQL_CODED} SELECT doc_id, label, array_to_string(ids, ' ') AS ids FROM listed",
)
def encode_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized = _tokenized(spark, sf_dir)
    encoded = _encoded(tokenized, _vocabulary(tokenized))
    return encoded.select("doc_id", "label", _joined(F.col("ids")).alias("ids"))


@registry.add(
    "pad_sequences",
    f"""{_SQL_CODED} SELECT doc_id, array_to_string(list_concat(ids[1:300],
  list_transform(range(greatest(300 - len(ids), 0)), lambda i: 0)), ' ') AS padded FROM listed""",
)
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized = _tokenized(spark, sf_dir)
    padded = tokens.pad_sequences(_encoded(tokenized, _vocabulary(tokenized)))
    return padded.select("doc_id", _joined(F.col("padded")).alias("padded"))


@registry.add(
    "one_hot",
    f"""WITH {fx.SQL_LABELLED}, dict AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y
  FROM (SELECT DISTINCT label FROM labelled))
SELECT l.doc_id, d.y, array_to_string(list_transform(range((SELECT count(*) FROM dict)),
  lambda i: CASE WHEN i = d.y THEN 1 ELSE 0 END), ' ') AS one_hot
FROM labelled l JOIN dict d ON d.label = l.label""",
)
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.labelled_documents(spark, sf_dir).select("doc_id", "label")
    dictionary = stage(labels.label_dictionary(docs, "label"), "dictionary")
    coded = labels.label_encode(docs, dictionary, "label")
    vector = one_hot(F.col("y"), dictionary.count())
    return coded.select("doc_id", "y", _joined(F.transform(vector, lambda v: v.cast("int"))).alias("one_hot"))


@registry.add(
    "class_weights", f"{_SQL_SPLIT} SELECT label, n, {_r6('weight')} AS weight FROM weights"
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = _split(spark, sf_dir)
    counts = labels.label_counts(rows.filter(F.col("part") == "train"), "label")
    weights = labels.class_weights(counts, "label")
    return weights.withColumn("weight", _rounded(F.col("weight")))


# --- training, scoring, evaluation -----------------------------------------------------


@registry.add(
    "nb_model",
    f"""{_SQL_MODEL} SELECT c.y, c.label, c.prior, c.base, x.idx, x.delta
FROM cells x JOIN classes c ON c.y = x.y""",
)
def nb_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _trained(spark, sf_dir).model
    return model.cells.join(model.classes, "y").select("y", "label", "prior", "base", "idx", "delta")


@registry.add(
    "nb_score",
    f"""{_SQL_SCORED} SELECT doc_id, string_agg(y || ':' || score, ' ' ORDER BY y) AS scores,
  string_agg(CAST(floor(prob * 1e6 + 0.5) AS BIGINT), ' ' ORDER BY y) AS millionths
FROM probs GROUP BY doc_id""",
)
def nb_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the vectors of scores and probabilities."""
    t = _trained(spark, sf_dir)
    scored = classify.probabilities(classify.score(t.rows, t.model), "length")
    pair = F.transform("scores", lambda s: F.concat_ws(":", s["y"].cast("string"), s["score"].cast("string")))
    return scored.select(
        "doc_id",
        F.array_join(pair, " ").alias("scores"),
        _joined(F.transform("probs", lambda p: F.floor(p * 1e6 + 0.5))).alias("millionths"),
    )


UNSEEN = " Improper Certificate Validation"  # sorts between two classes that have rows
_SQL_UNSEEN = _SQL_SCORED.replace(
    "FROM (SELECT label FROM listed GROUP BY label HAVING count(*) >= 2)",
    f"FROM (SELECT label FROM listed GROUP BY label HAVING count(*) >= 2 UNION ALL SELECT {fx.quote(UNSEEN)})",
)


@registry.add(
    "nb_unseen_class",
    f"""{_SQL_UNSEEN} SELECT doc_id, min(y) FILTER (r = 1) AS y_pred,
  min(trim(label)) FILTER (r = 1) AS label,
  min(score) FILTER (label = {fx.quote(UNSEEN)}) AS unseen_score FROM probs GROUP BY doc_id""",
)
def nb_unseen_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction with a dictionary that has a class without training rows in its middle."""
    predicted = _predicted(spark, sf_dir, unseen=(UNSEEN,))
    own = F.filter("scores", lambda s: s["y"] == 2)
    return predicted.select("doc_id", "y_pred", "label", F.get(own, F.lit(0))["score"].alias("unseen_score"))


@registry.add(
    "predict_top3",
    f"""{_SQL_SCORED} SELECT doc_id, min(trim(label)) FILTER (r = 1) AS label,
  {_r6('max(prob) FILTER (r = 1)')} AS confidence,
  string_agg(trim(label), '; ' ORDER BY r) FILTER (r <= 3) AS top_labels FROM probs GROUP BY doc_id""",
)
def predict_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select(
        "doc_id",
        "label",
        _rounded(F.col("confidence")).alias("confidence"),
        F.array_join(F.transform("top", lambda t: t["label"]), "; ").alias("top_labels"),
    )


_SQL_TESTED = f"""{_SQL_SCORED}, tested AS (
  SELECT s.doc_id, s.y, p.y AS y_pred, t.prob AS p_true FROM split s
  JOIN probs p ON p.doc_id = s.doc_id AND p.r = 1 JOIN probs t ON t.doc_id = s.doc_id AND t.y = s.y
  WHERE s.part = 'test')"""


@registry.add(
    "eval_accuracy",
    f"""{_SQL_TESTED} SELECT count(*) AS n, sum(CASE WHEN y = y_pred THEN 1 ELSE 0 END) AS correct,
  {_r6('avg(CASE WHEN y = y_pred THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM tested""",
)
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = classify.accuracy(_predicted(spark, sf_dir, "test"))
    return result.withColumn("accuracy", _rounded(F.col("accuracy")))


@registry.add(
    "eval_confusion",
    f"{_SQL_TESTED} SELECT y, y_pred, count(*) AS n FROM tested GROUP BY y, y_pred",
)
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.confusion(_predicted(spark, sf_dir, "test"))


@registry.add(
    "eval_logloss",
    f"""{_SQL_TESTED} SELECT count(*) AS n, {_r6('avg(-ln(greatest(p_true, 1e-7)))')} AS log_loss
FROM tested""",
)
def eval_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = classify.log_loss(_predicted(spark, sf_dir, "test"))
    return result.withColumn("log_loss", _rounded(F.col("log_loss")))


@registry.add(
    "lr_train_score",
    f"""{_SQL_SPLIT} SELECT y, count(*) AS n, true AS above_floor FROM split WHERE part = 'test' GROUP BY y""",
)
def lr_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on word counts: test documents per class, and whether the share of
    right predictions reaches the floor (a constant guess reaches about 0.56)."""
    vocab, _, rows = _split(spark, sf_dir)
    part_of = stage(rows.select("doc_id", "y", "label", "part"), "parts")
    weights = labels.class_weights(
        labels.label_counts(part_of.filter(F.col("part") == "train"), "label"), "label"
    )
    weighed = labels_with(part_of, stage(weights, "weights"))
    data = stage(_tokenized(spark, sf_dir).drop("label").join(weighed, "doc_id"), "lr-rows")
    train = data.filter(F.col("part") == "train")
    counter, model = classify.train_logistic_regression(train, vocab, "weight")
    test = model.transform(counter.transform(data.filter(F.col("part") == "test")))
    predicted = stage(test.select("y", F.col("prediction").cast("int").alias("y_pred")), "lr-predicted")
    accuracy = classify.accuracy(predicted).select("accuracy").scalar()
    counts = predicted.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("above_floor", accuracy >= LR_FLOOR)


def labels_with(rows: DataFrame, weights: DataFrame) -> DataFrame:
    return rows.join(weights.select("label", "weight"), "label")


@registry.add(
    "nb_top_classes",
    f"""{_SQL_SCORED} SELECT doc_id, string_agg(y || ':' || score, ' ' ORDER BY r) FILTER (r <= 3) AS best
FROM probs GROUP BY doc_id""",
)
def nb_top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes by the threshold algorithm, from a model in several shards."""
    t = _trained(spark, sf_dir)
    found = topk.top_classes(t.rows.select("doc_id", "ids"), t.model, shard_cells=10_000)
    pair = F.transform("best", lambda b: F.concat_ws(":", b["y"].cast("string"), b["score"].cast("string")))
    return found.select("doc_id", F.array_join(pair, " ").alias("best"))


# --- calibration ---------------------------------------------------------------------------

_SQL_THREE = f"""{_SQL_ENCODED},
split AS (SELECT *, CASE WHEN h < 0.7 * 4294967296.0 THEN 'train' WHEN h < 0.8 * 4294967296.0 THEN 'valid'
    ELSE 'test' END AS part
  FROM (SELECT *, {fx.sql_hash("CAST(doc_id AS VARCHAR)", "split")} AS h FROM encoded)),
"""
_SQL_CALIBRATED = (
    _SQL_MODEL.replace("WITH ", "WITH RECURSIVE ", 1).replace(_SQL_SPLIT[: _SQL_SPLIT.index("weights AS")].removeprefix("WITH "), _SQL_THREE.removeprefix("WITH "))
    + f""",
{_sql_scores("split", "doc_id")},
scaled AS (SELECT p.*, p.score / CAST(1e6 AS DOUBLE) / p.size AS v, s.part, s.y AS truth
  FROM probs p JOIN split s ON s.doc_id = p.doc_id),
tops AS (SELECT *, max(v) OVER (PARTITION BY doc_id) AS top FROM scaled),
newton AS (
  SELECT 0 AS i, CAST(1.0 AS DOUBLE) AS b
  UNION ALL
  SELECT i + 1, least(greatest(b - first / second, b / 4, 1e-3), b * 4, 1e3) FROM (
    SELECT i, b, sum(mean - of_true) AS first, sum(square - mean * mean) AS second FROM (
      SELECT i, b, doc_id, sum(v * e) / sum(e) AS mean, sum(v * v * e) / sum(e) AS square,
        max(v) FILTER (y = truth) AS of_true
      FROM (SELECT n.i, n.b, t.*, exp((t.v - t.top) * n.b) AS e FROM newton n, tops t
        WHERE t.part = 'valid' AND n.i < 30) GROUP BY i, b, doc_id) GROUP BY i, b)),
sharp AS (SELECT b FROM newton WHERE i = 30),
calibrated AS (SELECT doc_id, truth, part, y, label, e / sum(e) OVER (PARTITION BY doc_id) AS prob, r
  FROM (SELECT t.*, exp((t.v - t.top) * b) AS e FROM tops t, sharp)),
judged AS (SELECT doc_id, part, truth, y AS y_pred, trim(label) AS label, prob AS confidence
  FROM calibrated WHERE r = 1)"""
)


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the test part, with the sharpness fitted on the validation part."""
    tokenized = _tokenized(spark, sf_dir)
    vocab = _vocabulary(tokenized)
    coded, dictionary = labels.drop_rare_labels(stage(_encoded(tokenized, vocab), "encoded"), "label")
    rows = sampling.split_three(coded, F.col("doc_id").cast("string"))
    train = rows.filter("part = 'train'")
    weights = labels.class_weights(labels.label_counts(train, "label"), "label")
    model = classify.store(classify.train_naive_bayes(train, dictionary, weights=weights))
    scored = stage(classify.score(rows.filter("part <> 'train'"), model), "scored")
    sharpness = calibration.fit_sharpness(scored.filter("part = 'valid'"))
    tested = calibration.calibrated(scored.filter("part = 'test'").drop("label"), sharpness)
    return classify.predict(tested, _names(dictionary)).withColumn("sharpness", F.lit(sharpness))


@registry.add(
    "calibrated_confidence",
    f"""{_SQL_CALIBRATED} SELECT doc_id, label, {_r6('confidence')} AS confidence,
  CASE WHEN confidence < 0.3 THEN 'LOW' WHEN confidence < 0.6 THEN 'MEDIUM'
    WHEN confidence < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  (SELECT {_r6('b')} FROM sharp) AS sharpness FROM judged WHERE part = 'test'""",
)
def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).select(
        "doc_id",
        "label",
        _rounded(F.col("confidence")).alias("confidence"),
        rules.risk_level(F.col("confidence")).alias("risk_level"),
        _rounded(F.col("sharpness")).alias("sharpness"),
    )


@registry.add(
    "reliability_bins",
    f"""{_SQL_CALIBRATED} SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n,
  CAST(sum(CASE WHEN truth = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS correct, {_r6('avg(confidence)')} AS confidence,
  {_r6('abs(avg(CASE WHEN truth = y_pred THEN 1.0 ELSE 0.0 END) - avg(confidence))')} AS gap
FROM judged WHERE part = 'test' GROUP BY bin""",
)
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often test predictions of about one confidence are right."""
    found = calibration.reliability(_calibrated(spark, sf_dir))
    return found.withColumns({c: _rounded(F.col(c)) for c in ("confidence", "gap")})


# --- statistics and training over the whole joined corpus ----------------------------------

# The rows of the fan-out, word by word. Words of a row are those of its three parts.
_SQL_CORPUS_WORDS = f"""{fx.SQL_KEYED},
row_words AS (SELECT row_key, cwe_name, {_sql_tokens("text")} AS tokens FROM keyed),
corpus_words AS (SELECT cwe_name, word, count(*) AS n
  FROM (SELECT cwe_name, unnest(tokens) AS word FROM row_words) GROUP BY cwe_name, word)"""

_SQL_CORPUS_MODEL = f"""{_SQL_CORPUS_WORDS},
vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 1 AS idx
  FROM (SELECT word, sum(n) AS n FROM corpus_words GROUP BY word)),
kept AS (SELECT cwe_name AS label, count(*) AS docs FROM row_words WHERE len(tokens) > 0
  GROUP BY cwe_name HAVING count(*) >= 2),
classes AS (SELECT label, docs, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y,
    CAST(sum(docs) OVER () AS DOUBLE) / (count(*) OVER () * docs) AS weight FROM kept),
class_words AS (SELECT c.y, CASE WHEN v.idx < 10000 THEN v.idx ELSE 1 END AS idx, CAST(sum(w.n) AS BIGINT) AS n
  FROM corpus_words w JOIN classes c ON c.label = w.cwe_name JOIN vocab v ON v.word = w.word GROUP BY ALL),
sized AS (SELECT y, sum(n) AS tokens FROM class_words GROUP BY y)"""


def _statistics(spark: SparkSession, sf_dir: str) -> factorised.CorpusStatistics:
    return factorised.CorpusStatistics(corpus.Corpus(*fx.corpus_tables(spark, sf_dir)))


@registry.add(
    "corpus_word_counts",
    f"{_SQL_CORPUS_WORDS} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM corpus_words GROUP BY word",
)
def corpus_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word frequencies over every row of the joined corpus, none of which is made."""
    return _statistics(spark, sf_dir).word_counts()


@registry.add("corpus_vocabulary", f"{_SQL_CORPUS_MODEL} SELECT word, CAST(n AS BIGINT) AS n, idx FROM vocab")
def corpus_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).vocabulary()


@registry.add(
    "corpus_nb_model",
    f"""{_SQL_CORPUS_MODEL} SELECT c.y, c.label,
  CAST(round(ln(docs * weight / (SELECT sum(docs * weight) FROM classes)) * 1e6) AS BIGINT) AS prior,
  CAST(round(ln(1.0 / (s.tokens * weight + 10000.0)) * 1e6) AS BIGINT) AS base, CAST(w.idx AS INT) AS idx,
  CAST(round(ln(w.n * weight + 1) * 1e6) AS BIGINT) AS delta
FROM classes c JOIN sized s ON s.y = c.y JOIN class_words w ON w.y = c.y""",
)
def corpus_nb_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes trained on every row of the joined corpus."""
    model, _, _ = _statistics(spark, sf_dir).naive_bayes()
    return model.cells.join(model.classes, "y").select("y", "label", "prior", "base", "idx", "delta")


# --- page analysis and reports ---------------------------------------------------------

_AT = "2025-01-01 00:00:00"
_SQL_PAGE_TEXT = SQL_TEXT.removeprefix("WITH ")
_SQL_ANALYSIS = f"""{_SQL_MODEL}, {_SQL_PAGE_TEXT},
page_words AS (SELECT page_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos
  FROM (SELECT page_id, {_sql_tokens("text")} AS tokens FROM texts)),
page_ids AS (SELECT p.page_id, list(coalesce(v.idx, 1) ORDER BY p.pos) AS ids
  FROM page_words p LEFT JOIN vocab v ON v.word = p.word AND v.idx < 10000 GROUP BY p.page_id),
{_sql_scores("page_ids", "page_id")},
best AS (SELECT page_id, min(trim(label)) FILTER (r = 1) AS predicted,
    max(prob) FILTER (r = 1) AS confidence,
    list(trim(label) ORDER BY r) FILTER (r <= 3) AS labels3, list(prob ORDER BY r) FILTER (r <= 3)
    AS probs3 FROM probs GROUP BY page_id),
analysis AS (SELECT f.*, b.predicted, b.confidence, b.labels3, b.probs3,
    CASE WHEN confidence < 0.3 THEN 'LOW' WHEN confidence < 0.6 THEN 'MEDIUM'
      WHEN confidence < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
    {sql_recommendations("b.predicted")} AS advice
  FROM features f JOIN best b ON b.page_id = f.page_id)"""


def served(spark: SparkSession, sf_dir: str) -> model_store.Served:
    """The stored model of these tables: the first query of an application trains and publishes it,
    all others load it."""
    of_tables = zlib.crc32(sf_dir.encode())
    root = f"{shared_folder(spark)}/models/{spark.sparkContext.applicationId}-{of_tables:08x}"
    try:
        return model_store.load(spark, root)
    except LookupError:
        t = _trained(spark, sf_dir)
        model_store.publish(spark, root, t.model, t.vocab, _names(t.dictionary), {"max_len": "300"})
        return model_store.load(spark, root)


@registry.add(
    "model_published",
    f"""{_SQL_MODEL} SELECT 1 AS number, (SELECT count(*) FROM classes) AS classes, (SELECT count(*) FROM cells) AS cells,
  (SELECT count(*) FROM vocab) AS words, (SELECT count(*) FROM dict) AS labels, '300' AS max_len""",
)
def model_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the model that the analysis and the reports serve."""
    model = served(spark, sf_dir)
    sizes = {"classes": model.model.classes, "cells": model.model.cells, "words": model.vocab, "labels": model.labels}
    row = spark.range(1).select(F.lit(model.number).cast("long").alias("number"))
    counted = [t.agg(F.count(F.lit(1))).scalar().alias(name) for name, t in sizes.items()]
    return row.select("number", *counted, F.lit(model.facts["max_len"]).alias("max_len"))


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = served(spark, sf_dir)
    at = F.lit(_AT).cast("timestamp")
    return reports.analyze_pages(fx.site_pages(spark, sf_dir), m.vocab, m.model, m.labels, at)


@registry.add(
    "analyze_pages",
    f"""{_SQL_ANALYSIS} SELECT page_id, url, predicted AS predicted_vulnerability,
  {_r6('confidence')} AS confidence, array_to_string(labels3, '; ') AS top_labels, risk_level,
  array_to_string(advice, '; ') AS advice, '{_AT}' AS analysis_timestamp,
  'length' AS temperature FROM analysis""",
)
def analyze_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).select(
        "page_id",
        "url",
        "predicted_vulnerability",
        _rounded(F.col("confidence")).alias("confidence"),
        F.array_join(F.transform("top_3_predictions", lambda t: t["label"]), "; ").alias("top_labels"),
        "risk_level",
        F.array_join("recommendations", "; ").alias("advice"),
        "analysis_timestamp",
        "temperature",
    )


@registry.add(
    "report_main",
    f"""{_SQL_ANALYSIS} SELECT url AS "URL", '{_AT}' AS "Analysis_Timestamp",
  risk_level AS "Risk_Level", predicted AS "Predicted_Vulnerability",
  printf('%.4f', confidence) AS "Confidence",
  labels3[1] || printf(' (%.3f)', probs3[1]) AS "Top_Prediction_1",
  labels3[2] || printf(' (%.3f)', probs3[2]) AS "Top_Prediction_2",
  labels3[3] || printf(' (%.3f)', probs3[3]) AS "Top_Prediction_3",
  security_headers <> '' AS "Security_Headers_Present", technologies AS "Technologies_Detected",
  forms <> '' AS "Forms_Found", CAST(len(advice) AS INT) AS "Recommendations_Count" FROM analysis""",
)
def report_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.main_report(_analysis(spark, sf_dir))


@registry.add(
    "report_recommendations",
    f"""{_SQL_ANALYSIS} SELECT page_id, url, CAST(generate_subscripts(advice, 1) AS INT) AS "Rank",
  unnest(advice) AS "Recommendation" FROM analysis""",
)
def report_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recommendations_report(_analysis(spark, sf_dir))


@registry.add(
    "report_features",
    f"{_SQL_ANALYSIS} "
    + " UNION ALL ".join(
        f"""SELECT page_id, url, '{f}' AS "Feature_Type",
  md5(CASE WHEN {f} = '' THEN 'None' ELSE left({f}, 500) END) AS "Content" FROM analysis"""
        for f in FEATURES
    ),
)
def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.features_report(_analysis(spark, sf_dir)).withColumn("Content", F.md5("Content"))


@registry.add(
    "report_technical",
    f"""{_SQL_ANALYSIS} SELECT page_id, left(technologies, 100) AS "Technologies_Detected",
  CASE WHEN security_headers <> '' THEN 'Present' ELSE 'Missing' END AS "Security_Headers",
  CASE WHEN forms <> '' THEN 'Yes' ELSE 'No' END AS "Forms_Detected",
  CASE WHEN links <> '' THEN 'Found' ELSE 'None' END AS "Suspicious_Links",
  left(errors, 100) AS "Error_Patterns", risk_level,
  CASE risk_level WHEN 'LOW' THEN 'green' WHEN 'MEDIUM' THEN 'orange' WHEN 'HIGH' THEN 'red'
    ELSE 'darkred' END AS risk_colour FROM analysis""",
)
def report_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.technical_report(_analysis(spark, sf_dir))


@registry.add(
    "report_details",
    f"""{_SQL_ANALYSIS} SELECT page_id, url AS "URL", '{_AT}' AS "Analysis_Date",
  risk_level AS "Risk_Level", predicted AS "Predicted_Vulnerability",
  printf('%.2f%%', confidence * 100) AS "Confidence_Score" FROM analysis""",
)
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.details_report(_analysis(spark, sf_dir))


@registry.add(
    "report_top3",
    f"""{_SQL_ANALYSIS} SELECT page_id, CAST(r AS INT) AS "Rank",
  trim(label) AS "Vulnerability_Type", printf('%.2f%%', prob * 100) AS "Confidence"
FROM probs WHERE r <= 3""",
)
def report_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_report(_analysis(spark, sf_dir))
