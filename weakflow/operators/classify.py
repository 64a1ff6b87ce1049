"""Distributed text classification: training, batch scoring, prediction and evaluation.

The countable classifier is a multinomial naive Bayes over encoded sequences. Its log
probabilities are fixed-point integers (millionths), so sums do not depend on the order
of the rows. A class is (prior, base); a cell adds ``delta`` for a word that the class has
seen, so the model needs no classes x vocabulary product:

    score(doc, y) = prior[y] + len(doc) * base[y] + sum(delta[y, id])
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.operators.tokens import MAX_NUM_WORDS, NUM_WORDS
from weakflow.sources.staging import stage

SCALE = 1_000_000
TABLE_BYTES = 256 << 20  # bound of the dense table (words x classes) that is sent to the tasks
_GATHERED = 1 << 21  # numbers gathered at once while scoring
MAX_CLASSES = 100_000  # bound of the label names that are held in one row
NO_ROWS_PRIOR = -50 * SCALE  # log prior of a class without training rows


@dataclass(frozen=True)
class NaiveBayes:
    """classes: (y, label, prior, base); cells: (y, idx, delta)."""

    classes: DataFrame
    cells: DataFrame


def _fixed(x: Column) -> Column:
    return F.round(F.log(x) * SCALE).cast("long")


def train_naive_bayes(
    df: DataFrame,
    dictionary: DataFrame,
    num_words: int = NUM_WORDS,
    alpha: float = 1.0,
    weights: DataFrame | None = None,
) -> NaiveBayes:
    """Train on (y, ids). ``weights`` (label, weight) scales the counts of each class; a class
    without a weight has weight 1. Every class of the dictionary is in the model, also one
    without training rows."""
    words = df.select("y", F.explode("ids").alias("idx"))
    counts = stage(words.groupBy("y", "idx").agg(F.count(F.lit(1)).alias("n")), "class-words")
    # The tokens of a class are those of its counts, so the long rows of ids are read once.
    docs = df.groupBy("y").agg(F.count(F.lit(1)).alias("docs"))
    sizes = docs.join(counts.groupBy("y").agg(F.sum("n").alias("tokens")), "y", "left")
    return naive_bayes_of_counts(counts, sizes, dictionary, num_words, alpha, weights)


def naive_bayes_of_counts(
    counts: DataFrame,
    sizes: DataFrame,
    dictionary: DataFrame,
    num_words: int = NUM_WORDS,
    alpha: float = 1.0,
    weights: DataFrame | None = None,
) -> NaiveBayes:
    """The model of counts (y, idx, n) and class sizes (y, docs, tokens)."""
    names = dictionary.select(F.col("idx").alias("y"), "label")
    nothing = F.lit(0).cast("long")
    sizes = names.join(sizes, "y", "left").select(
        "y",
        "label",
        F.coalesce("docs", nothing).alias("docs"),
        F.coalesce("tokens", nothing).alias("tokens"),
    )
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        sizes = sizes.join(weights.select(F.col("label"), "weight"), "label", "left")
        sizes = sizes.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sizes = stage(sizes, "class-sizes")
    docs = sizes.agg(F.sum(F.col("docs") * F.col("weight"))).scalar()
    smoothed = F.col("tokens") * F.col("weight") + F.lit(alpha) * num_words
    classes = sizes.select(
        "y",
        "label",
        F.when(F.col("docs") > 0, _fixed(F.col("docs") * F.col("weight") / docs))
        .otherwise(NO_ROWS_PRIOR)
        .alias("prior"),
        _fixed(F.lit(alpha) / smoothed).alias("base"),
    )
    cells = counts.join(sizes.select("y", "weight"), "y").select(
        "y", "idx", _fixed(F.col("n") * F.col("weight") / F.lit(alpha) + 1).alias("delta")
    )
    return NaiveBayes(classes, cells)


def store(model: NaiveBayes) -> NaiveBayes:
    return NaiveBayes(stage(model.classes, "nb-classes"), stage(model.cells, "nb-cells"))


def table_bytes(model: NaiveBayes) -> int:
    """Bytes of the dense table of a stored model."""
    words = model.cells.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0] + 2
    return words * model.classes.count() * 8


def score_by_lookup(df: DataFrame, model: NaiveBayes) -> DataFrame:
    """Adds ``scores``, an array of (y, score) in the order of y, inside the scan of ``df``.

    For a model of bounded size, which is sent to the tasks once as a dense table. Words are
    gathered a bounded number at a time and summed per text; exploding words x classes into a
    shuffle would move many times more data.
    """
    if table_bytes(model) > TABLE_BYTES:
        raise ValueError("the model is too large to be sent to the tasks; use score_by_join")
    classes = model.classes.orderBy("y").collect()
    place = {c["y"]: i for i, c in enumerate(classes)}
    cells = model.cells.toArrow()
    idx = cells["idx"].to_numpy()
    table = np.zeros((int(idx.max(initial=0)) + 2, len(classes)), dtype=np.int64)
    table[idx, [place[y] for y in cells["y"].to_pylist()]] = cells["delta"].to_numpy()
    prior = np.array([c["prior"] for c in classes], dtype=np.int64)
    base = np.array([c["base"] for c in classes], dtype=np.int64)
    ys = np.array(list(place), dtype=np.int32)
    shared = df.sparkSession.sparkContext.broadcast((table, prior, base, ys))

    @F.arrow_udf("array<struct<y:int,score:bigint>>")
    def scores(ids: pa.Array) -> pa.Array:
        table, prior, base, ys = shared.value
        k = len(ys)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = prior + sizes[:, None] * base
        # A bounded number of words at a time; nothing as long as all words of the batch is made.
        ends, words = np.cumsum(sizes), ids.flatten()
        step = max(1, _GATHERED // k)
        for lo in range(0, len(words), step):
            hi = min(lo + step, len(words))
            # Words beyond the table were never seen in training: its last row is zero.
            some = np.minimum(words.slice(lo, hi - lo).to_numpy(zero_copy_only=False), len(table) - 1)
            rows = np.arange(np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right") + 1)
            rows = rows[sizes[rows] > 0]
            first = np.maximum(ends[rows] - sizes[rows], lo) - lo
            out[rows] += np.add.reduceat(table[some], first, axis=0)
        offsets = np.arange(0, out.size + 1, k, dtype=np.int32)
        entries = pa.StructArray.from_arrays(
            [pa.array(np.tile(ys, len(out)), pa.int32()), pa.array(out.ravel())], names=["y", "score"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    # The mark keeps it a step of its own; Spark cannot run it inside an array expression.
    return df.withColumn("scores", scores.asNondeterministic()("ids"))


def score_by_join(df: DataFrame, model: NaiveBayes) -> DataFrame:
    """Adds the same ``scores`` by joining words with the cells, for a model of any size.

    Rows get a number of their own in a stored copy, so repeated or NULL ids do not matter. A
    stream cannot be stored and is refused.
    """
    if df.isStreaming:
        raise ValueError("this model is too large to score a stream")
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "to-score")
    words = rows.select("_row", F.explode("ids").alias("idx"))
    counted = words.groupBy("_row", "idx").agg(F.count(F.lit(1)).alias("n"))
    hits = counted.join(model.cells, "idx")
    sums = hits.groupBy("_row", "y").agg(F.sum(F.col("n") * F.col("delta")).alias("s"))
    by_row = sums.groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("y", "s"))).alias("_sums")
    )
    listed = model.classes.agg(F.sort_array(F.collect_list(F.struct("y", "prior", "base")))).scalar()
    joined = rows.join(by_row, "_row", "left").withColumn("_classes", listed)
    none, size = F.lit(0).cast("long"), F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    return joined.withColumn("_size", F.greatest(size, none)).withColumn(
        "scores",
        F.transform(
            F.col("_classes"),
            lambda c: F.struct(
                c["y"].alias("y"),
                (c["prior"] + F.col("_size") * c["base"] + F.coalesce(F.element_at("_sums", c["y"]), none)).alias(
                    "score"
                ),
            ),
        ),
    ).drop("_row", "_sums", "_classes", "_size")


def score(df: DataFrame, model: NaiveBayes) -> DataFrame:
    """Adds ``scores`` to rows with ``ids``, as an array of (y, score) in the order of y. Both
    ways give the same; the size of the stored model's table decides between them."""
    if table_bytes(model) <= TABLE_BYTES:
        return score_by_lookup(df, model)
    return score_by_join(df, model)


def probabilities(df: DataFrame, temperature: str = "none") -> DataFrame:
    """Adds ``probs``: softmax of the scores, shifted by their maximum, in the order of the scores.

    Long texts push naive Bayes to 0 or 1. ``temperature='length'`` divides the scores by
    the number of tokens first.
    """
    size = F.greatest(F.size("ids"), F.lit(1)) if temperature == "length" else F.lit(1)
    values = F.transform("scores", lambda s: s["score"])
    top = F.array_max(values)
    weights = F.transform("scores", lambda s: F.exp((s["score"] - top) / F.lit(float(SCALE)) / size))
    weighed = df.withColumn("_w", weights)
    total = F.aggregate("_w", F.lit(0.0), lambda a, b: a + b)
    return weighed.withColumn("probs", F.transform("_w", lambda w: w / total)).drop("_w")


def predict(df: DataFrame, labels: DataFrame, top: int = 3) -> DataFrame:
    """Adds y_pred, label, confidence and ``top`` (rank order: score down, index up).

    ``labels`` is (idx, label), one row per class and at most ``MAX_CLASSES`` of them. The class
    of a score is its own ``y``, never its place. A missing index reads 'Unknown' as the
    prediction and 'Class_i' in the list.
    """
    if labels.count() > MAX_CLASSES:
        raise ValueError(f"at most {MAX_CLASSES} classes")
    names = labels.agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.trim("label").alias("label"))))
    ).scalar()
    ranked = F.array_sort(
        F.transform(
            F.arrays_zip("scores", "probs"),
            lambda e: F.struct(
                (-e["scores"]["score"]).alias("down"), e["scores"]["y"].alias("idx"), e["probs"].alias("confidence")
            ),
        )
    )
    listed = df.withColumn("_best", F.slice(ranked, 1, top))
    listed = listed.withColumn("_names", names).withColumn("_all_names", names)
    first = F.get("_best", F.lit(0))
    return listed.withColumn("y_pred", first["idx"]).select(
        *df.columns,
        "y_pred",
        F.coalesce(F.element_at("_names", F.col("y_pred")), F.lit("Unknown")).alias("label"),
        first["confidence"].alias("confidence"),
        F.transform(
            "_best",
            lambda b: F.struct(
                F.coalesce(
                    F.element_at("_all_names", b["idx"]), F.concat(F.lit("Class_"), b["idx"].cast("string"))
                ).alias("label"),
                b["confidence"].alias("confidence"),
            ),
        ).alias("top"),
    )


def accuracy(df: DataFrame) -> DataFrame:
    hit = (F.col("y_pred") == F.col("y")).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def log_loss(df: DataFrame) -> DataFrame:
    """Mean of -ln p(true class), with p kept in [1e-7, 1]."""
    of_true = F.filter(F.arrays_zip("scores", "probs"), lambda e: e["scores"]["y"] == F.col("y"))
    p = F.greatest(F.coalesce(F.get(of_true, F.lit(0))["probs"], F.lit(0.0)), F.lit(1e-7))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(p)).alias("log_loss"))


def train_logistic_regression(
    df: DataFrame,
    vocab: DataFrame,
    weight: str | None = None,
    max_iter: int = 20,
    num_words: int = NUM_WORDS,
) -> tuple[CountVectorizerModel, LogisticRegressionModel]:
    """Weighted logistic regression on word counts; rows have ``tokens`` and ``y``.

    The words with ``idx < num_words`` are the only rows that reach the driver.
    """
    if num_words > MAX_NUM_WORDS:
        raise ValueError(f"num_words is at most {MAX_NUM_WORDS}")
    known = vocab.filter(F.col("idx") < num_words)
    words = [r["word"] for r in known.orderBy("idx").select("word").collect()]
    counter = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="features")
    params = {"labelCol": "y", "featuresCol": "features", "maxIter": max_iter, "regParam": 0.01}
    if weight:
        params["weightCol"] = weight
    return counter, LogisticRegression(**params).fit(counter.transform(df))
