"""Confidence that means something: a fitted temperature, and how far it can be trusted.

Naive Bayes counts every word as new evidence, so its probabilities lie near 0 and 1. Scores are divided
by the length of the text and multiplied by one number, the sharpness, which is the inverse of a
temperature. The sharpness is the minimum of the log loss over a validation part that training has not
seen. That loss is convex in it, and each step of a Newton search needs three sums over the validation
rows, which Spark adds up where the rows are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.operators.classify import SCALE

ROUNDS = 30
LARGEST = 4.0  # factor by which one step changes the sharpness at most
RANGE = (1e-3, 1e3)


def per_token() -> Column:
    """The scores of a row in natural units, divided by its tokens, in the order of the scores."""
    size = F.greatest(F.coalesce(F.size("ids"), F.lit(1)), F.lit(1))
    return F.transform("scores", lambda s: s["score"] / F.lit(float(SCALE)) / size)


def softmax(values: Column, sharpness: float) -> Column:
    """Probabilities of an array of values, shifted by their maximum."""
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp((v - top) * F.lit(sharpness)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.transform(weights, lambda w: w / total)


def slopes(rows: DataFrame, sharpness: float) -> tuple[float, float, int]:
    """(first derivative, second derivative, rows) of the summed log loss; ``rows`` are (values, of_true)."""
    with_p = rows.withColumn("_p", softmax(F.col("values"), sharpness))
    pairs = F.arrays_zip(F.col("values").alias("v"), F.col("_p").alias("p"))
    mean = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["v"] * e["p"])
    with_mean = with_p.withColumn("_mean", mean)
    spread = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["p"] * (e["v"] - F.col("_mean")) * (e["v"] - F.col("_mean")))
    sums = with_mean.agg(F.sum(F.col("_mean") - F.col("of_true")), F.sum(spread), F.count(F.lit(1))).first()
    return float(sums[0] or 0.0), float(sums[1] or 0.0), sums[2]


def fit_sharpness(validation: DataFrame, rounds: int = ROUNDS) -> float:
    """The sharpness with the least log loss on rows with ``scores``, ``ids`` and the true class ``y``.

    Rows whose class has no score say nothing and are left out; without rows the sharpness is 1. Where
    every row is right, the loss falls for ever, and the search ends at the edge of ``RANGE``. ``validation``
    is read once per round, so pass a stored table.
    """
    named = F.map_from_arrays(F.transform("scores", lambda s: s["y"]), per_token())
    rows = validation.select(per_token().alias("values"), F.element_at(named, F.col("y")).alias("of_true"))
    rows = rows.filter(F.col("of_true").isNotNull())
    sharpness = 1.0
    for _ in range(rounds):
        first, second, count = slopes(rows, sharpness)
        if not count:
            return 1.0
        wanted = sharpness - first / second if second > 0 else sharpness * (LARGEST if first < 0 else 1 / LARGEST)
        wanted = min(max(wanted, sharpness / LARGEST), sharpness * LARGEST)
        wanted = min(max(wanted, RANGE[0]), RANGE[1])
        done = abs(wanted - sharpness) <= 1e-12 * sharpness
        sharpness = wanted
        if done:
            break
    return sharpness


def calibrated(df: DataFrame, sharpness: float) -> DataFrame:
    """Adds ``probs`` to rows with ``scores`` and ``ids``, in the order of the scores."""
    return df.withColumn("probs", softmax(per_token(), sharpness))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, correct, confidence, gap) of rows with ``confidence``, ``y`` and ``y_pred``: how often
    predictions of about one confidence are right. Bin i holds confidences from i/bins up to (i+1)/bins."""
    place = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    right = F.coalesce((F.col("y") == F.col("y_pred")).cast("long"), F.lit(0))
    found = df.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("correct"), F.avg("confidence").alias("confidence")
    )
    return found.withColumn("gap", F.abs(F.col("correct") / F.col("n") - F.col("confidence")))
