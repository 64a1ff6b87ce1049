"""Quality rules: divergence of a text from the references of its language (DataFrame functions).

Every text gets two histograms: its characters by class, and its words by the common words of
its language (the rest is one entry). The references of a language are the same histograms
summed over all its texts in the table. The Jensen-Shannon distance (the root of the
divergence in bits, 0 to 1) between text and reference is compared with a bound for each kind
of histogram. Short texts are guarded: below ``MIN_CHARS`` characters or ``MIN_WORDS`` words
the histogram says too little, and that distance is not judged (NULL). Texts of a language
without a list of common words are judged by their characters only, against their own
language, and texts without a language against all texts.

Base rules come before: too few words, or too many words in repeated three-word windows.

A NULL or empty text has no words and fails the base rules. Rows with the same id stay separate
rows. An empty table gives no rows. Columns with clashing names are not touched: the result
has only the named columns, or (``judge``) the input columns with one struct added.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

MIN_WORDS, MIN_CHARS = 100, 200
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50

# Common function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from".split(),
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als".split(),
    "es": "de la que el en y los se las del un por con no su una para es al lo".split(),
}
_SPACE = " \t\n\x0b\x0c\r"
_CLASSES = {"upper": r"\p{Lu}+", "digits": r"\p{Nd}+", "symbols": r"[#*$%&|<>]+", "marks": r"[\p{P}\p{S}&&[^#*$%&|<>]]+"}
CHAR_BINS = ["space", *_CLASSES, "letters"]


def _array_sum(a: Column, zero: str = "long") -> Column:
    return F.aggregate(a, F.lit(0).cast(zero), lambda s, x: s + x)


def _in(listed: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*listed)


def _profile(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, base counts, chars, words): one row per row of ``df``.

    Intermediate arrays are columns of their own, each used more than once, so that Spark
    evaluates each of them once per row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    n_of = {name: F.char_length("text") - F.char_length(F.regexp_replace("text", p, "")) for name, p in _CLASSES.items()}
    trimmed = F.btrim("text", F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(_SPACE)) != "")
    step = df.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), whole.alias("text"))
    step = step.select("doc_id", "lang", "text", words.alias("w"), lines.alias("lines"))
    common = F.array().cast("array<string>")
    for name, listed in COMMON_WORDS.items():
        common = F.when(F.col("lang") == name, F.filter("w", _in(listed))).otherwise(common)
    step = step.select(
        "doc_id",
        "lang",
        F.char_length("text").cast("long").alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        *[n.cast("long").alias(name) for name, n in n_of.items()],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        common.alias("common"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # Three-word windows by the hash of their words.
    n = F.greatest(F.size("h") - 2, F.lit(0))
    triples = F.arrays_zip(F.slice("h", 1, n), F.slice("h", 2, n), F.slice("h", 3, n))
    step = step.withColumn("g", F.transform(triples, lambda x: F.xxhash64(x))).drop("h")
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(repeats, placed)).drop("g")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice("s", 1, F.size("s") - 1))
    after = F.concat(F.slice("s", 2, F.size("s")), none)
    beside = F.arrays_zip(F.col("s").alias("s"), before.alias("b"), after.alias("a"))
    twice = F.filter(
        beside, lambda z: z["s"]["h"].eqNullSafe(z["b"]["h"]) | z["s"]["h"].eqNullSafe(z["a"]["h"])
    )
    places = F.sort_array(F.transform(twice, lambda z: z["s"]["i"]))
    step = step.withColumn("p", F.when(F.col("s").isNotNull(), places)).drop("s")
    # Each repeated window covers three words, less what the next one covers as well.
    gaps = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(_array_sum(gaps))
    counts = F.array().cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        own = F.array(*[(F.size("common") - F.size(F.array_remove("common", x))).cast("long") for x in listed])
        counts = F.when(F.col("lang") == name, own).otherwise(counts)
    step = step.withColumns({"n_repeat_words": covered, "counts": counts}).drop("p")
    other = F.col("n_words") - F.size("common")
    letters = F.col("word_chars") - sum(F.col(name) for name in _CLASSES)
    chars = F.array(F.col("n_chars") - F.col("word_chars"), *[F.col(c) for c in _CLASSES], letters)
    return step.select(
        "doc_id",
        "lang",
        "n_chars",
        "n_words",
        "word_chars",
        F.col("symbols").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        chars.alias("chars"),
        F.when(F.size("counts") > 0, F.concat("counts", F.array(other))).alias("words"),
    )


def references(profile: DataFrame) -> DataFrame:
    """(lang, chars, words): summed histograms; the row with a NULL lang sums all texts."""
    n_words = max(len(w) for w in COMMON_WORDS.values()) + 1

    def sums(name: str, n: int) -> list[Column]:
        return [F.coalesce(F.sum(F.get(name, F.lit(i))), F.lit(0)).cast("long").alias(f"{name}{i}") for i in range(n)]

    def gathered(rows: DataFrame, lang: Column) -> DataFrame:
        return rows.select(
            lang.alias("lang"),
            F.array(*[F.col(f"chars{i}") for i in range(len(CHAR_BINS))]).alias("ref_chars"),
            F.array(*[F.col(f"words{i}") for i in range(n_words)]).alias("ref_words"),
        )

    totals = [*sums("chars", len(CHAR_BINS)), *sums("words", n_words)]
    known = profile.filter(F.col("lang").isNotNull())
    by_lang = gathered(known.groupBy("lang").agg(*totals), F.col("lang"))
    return by_lang.unionByName(gathered(profile.agg(*totals), F.lit(None).cast("string")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, in bits; NULL if one is empty."""
    np, nq = _array_sum(p).cast("double"), _array_sum(q).cast("double")
    shares = F.zip_with(p, q, lambda a, b: F.struct((a / np).alias("p"), (b / nq).alias("q")))

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)

    terms = F.transform(shares, lambda z: part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when((np > 0) & (nq > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def score(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Base counts, both distances, base_failed and kept of every row."""
    profile = stage(_profile(df, key, text, lang), "profiles")
    refs = stage(references(profile), "references")
    # A language is told by its own reference row; NULL by that of all texts.
    joined = profile.join(refs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    width = F.size("words")
    char_distance = F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("chars"), F.col("ref_chars")))
    word_distance = F.when(
        (F.col("n_words") >= MIN_WORDS) & (width > 1),
        distance(F.col("words"), F.slice("ref_words", 1, width)),
    )
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    )
    scored = joined.withColumns(
        {"char_distance": char_distance, "word_distance": word_distance, "base_failed": failed}
    )
    return scored.select(
        F.col("doc_id").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "char_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
