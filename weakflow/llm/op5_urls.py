"""URL filter: host and path rules, and gradient-boosted trees on lexical features.

DataFrame functions and Spark ML's trees only; no Python runs on the executors.

A rule names a host and a path; it fits that host with all its subdomains if the path of the
URL starts with the rule's. The longest fitting rule decides. URLs without a rule are judged
by trees trained from labelled URLs: their features are the length, the depth of the path,
the ratio of digits, the entropy of the characters, the number of parameters, and statistics
of the host's suffix (how common it is in all URLs, and how often its labelled URLs are bad).
Suffixes are counted over all rows, without a limit; only the fit of the trees uses a sample. Few
labelled URLs pull a suffix towards the prior, and the trees see a URL with the statistics of
the other parts of the labelled URLs, since its own label would tell too much of a rare suffix.

A NULL URL, or one without ``://``, has an empty host and path, fits no rule, and is judged
by the trees like any other. Repeated ids stay separate rows. Without labelled URLs of both
kinds no trees are grown, and the prior decides (allow if nothing is labelled).
"""

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.operators.joins import broadcast_if_small, spread_left_join
from weakflow.sources.staging import stage

TRAINING_ROWS = 20_000  # bound of the labelled sample that the trees are fitted on
PARTS = 5  # parts of the labelled URLs; the trees see each with the suffix statistics of the others
PRIOR_ROWS = 10.0  # rows of the prior that are added to the labelled URLs of a suffix
TREES = 20
DEPTH = 4
BLOCK_FROM = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = (
    "length depth host_labels digit_ratio entropy parameters fragment hyphens suffix_share suffix_bad"
).split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_columns(rules: list[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(text of the longest fitting rule, its verdict); NULL where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        of_host = (F.col(host) == r.host) | F.col(host).endswith("." + r.host)
        fits = of_host & F.col(path).startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(kinds, lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and the lexical features of a URL."""
    text = F.coalesce(F.col(url), F.lit(""))
    length = F.char_length(text)
    without_digits = F.char_length(F.regexp_replace(text, "[0-9]+", ""))
    named = df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    steps = F.size(F.filter(F.split("path", "/"), lambda s: s != ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return named.withColumns(
        {
            "suffix": suffix(F.col("host")),
            "length": length.cast("double"),
            "depth": steps.cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": (length - without_digits) / F.greatest(length, F.lit(1)),
            "entropy": _entropy(text),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
            "fragment": F.contains(text, F.lit("#")).cast("double"),
            "hyphens": (F.char_length("host") - F.char_length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
        }
    )


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


@dataclass(frozen=True)
class UrlModel:
    """The trees (None if they could not be grown), the prior and the suffix statistics, a
    stored table with a row for every suffix of the URLs that it was made from."""

    trees: GBTClassificationModel | None
    prior: float
    suffixes: DataFrame


def _with_suffixes(df: DataFrame, stats: DataFrame, prior: float) -> DataFrame:
    """Adds the statistics, by a broadcast if the measured table is small. A suffix that was
    never seen has a share of 0 and the prior."""
    small = broadcast_if_small(stats)
    joined = df.join(small, "suffix", "left") if small is not stats else spread_left_join(df, stats, "suffix", right_unique=True)
    return joined.withColumns(
        {
            "suffix_share": F.coalesce("suffix_share", F.lit(0.0)),
            "suffix_bad": F.coalesce("suffix_bad", F.lit(prior)),
        }
    )


def _bad_rate(bad: Column, n: Column, prior: float) -> Column:
    return (bad + F.lit(PRIOR_ROWS * prior)) / (n + F.lit(PRIOR_ROWS))


def train(
    labelled: DataFrame,
    url: str = "url",
    label: str = "bad",
    rows: int = TRAINING_ROWS,
    pages: DataFrame | None = None,
) -> UrlModel:
    """Grow trees from (url, label) with label 0 or 1.

    About ``rows`` labelled rows at most are used for the fit. Equal rows are counted first, and of
    c equal ones c * rows / n stay, as a weight, with the fraction rounded up or down by a hash of
    the row: a hot URL keeps its share, and neither its size nor that of the table breaks the bound.
    The share of a suffix is counted over the ``url`` of all ``pages``, or else of the labelled URLs.
    """
    known = labelled.filter(F.col(label).isNotNull() & F.col(url).isNotNull())
    known = known.select(F.col(url).alias("url"), F.col(label).cast("double").alias("bad"))
    of_url = suffix(host(F.col("url"))).alias("suffix")
    part = F.pmod(F.xxhash64("url", F.lit("part")), F.lit(PARTS)).alias("part")
    by_part = known.select("bad", of_url, part).groupBy("suffix", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    by_part = stage(by_part, "url-suffix-parts")
    n, all_bad = by_part.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    prior = float((all_bad + 1) / (n + 2)) if n else 0.0
    every = known.select("url") if pages is None else pages.select(F.col(url).alias("url"))
    shares = stage(every.select(of_url).groupBy("suffix").agg(F.count(F.lit(1)).alias("pages")), "url-suffix-pages")
    n_pages = shares.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    labels = by_part.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counted = shares.join(labels, "suffix", "full").fillna(0)
    counted = counted.withColumn("suffix_share", F.col("pages") / F.lit(float(max(1, n_pages))))
    counted = stage(counted.select("suffix", "suffix_share", "n", "bad"), "url-suffix-counts")
    stats = counted.select("suffix", "suffix_share", _bad_rate(F.col("bad"), F.col("n"), prior).alias("suffix_bad"))
    stats = stage(stats, "url-suffixes")

    known = known.groupBy("url", "bad").agg(F.count(F.lit(1)).alias("copies"))
    chance = F.pmod(F.xxhash64("url", "bad", F.lit("sample")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    taken = F.floor(F.col("copies") * F.lit(min(1.0, rows / n if n else 1.0)) + chance)
    known = known.withColumn("weight", F.when(F.lit(n <= rows), F.col("copies")).otherwise(taken).cast("double"))
    known = known.filter("weight > 0").drop("copies")
    known = stage(lexical(known).withColumn("part", part), "url-training")
    total, bad = known.agg(F.sum("weight"), F.sum(F.col("bad") * F.col("weight"))).first()
    trees = None
    if total and 0 < bad < total:
        own = by_part.select("suffix", "part", F.col("n").alias("own_n"), F.col("bad").alias("own_bad"))
        others = own.join(counted, "suffix").select(
            "suffix",
            "part",
            "suffix_share",
            _bad_rate(F.col("bad") - F.col("own_bad"), F.col("n") - F.col("own_n"), prior).alias("suffix_bad"),
        )
        points = known.join(others, ["suffix", "part"])  # each labelled URL has its suffix and part there
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
        points = stage(ready.transform(points).select("features", "bad", "weight"), "url-points")
        fit = GBTClassifier(featuresCol="features", labelCol="bad", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7)
        trees = fit.fit(points)
    return UrlModel(trees, prior, stats)


def judge(df: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """Adds host, path, rule, p_bad and verdict to every row."""
    out = ("host", "path", "rule", "p_bad", "verdict")
    given = [c for c in df.columns if c not in out]
    # Own names for the work, whatever other columns the table has.
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), F.col(url).alias("_url"))
    seen = _with_suffixes(lexical(work, "_url"), model.suffixes, model.prior)
    if model.trees is not None:
        seen = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen)
        seen = model.trees.transform(seen)
        seen = seen.withColumn("p_bad", vector_to_array("probability")[1])
    else:
        seen = seen.withColumn("p_bad", F.lit(model.prior))
    text, verdict = rule_columns(rules)
    own = F.when(F.col("p_bad") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return seen.withColumns({"rule": text, "verdict": F.coalesce(verdict, own)}).select("_row.*", *out)
