"""Corpus statistics without the fan-out: words counted once per name and weighted by copies.

A corpus row is a CVE with one of its products and one of the product's vendors, and its text is
summary, product and vendor joined by spaces. So its tokens are those of the three parts, one after
another, and sums over all rows come apart:

    rows with a summary  = rows of its CVE                        (products x vendors)
    rows with a product  = CVEs that name it x its vendors        (per label)
    rows with a vendor   = CVEs that name the product x copies    (per label, summed over products)

Each summary, product name and vendor name is tokenised once, whatever the number of rows it stands
in. The largest table made is (label, product, vendor); no step has a row per corpus row. Joins go
through ``spread_left_join``, which splits hot keys; sums are combined before each shuffle.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.functions.text import split_words, tokenize
from weakflow.operators import classify, labels
from weakflow.operators.corpus import Corpus
from weakflow.operators.joins import spread_left_join
from weakflow.operators.ranks import global_rank
from weakflow.operators.tokens import NUM_WORDS, OOV
from weakflow.sources.staging import stage


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _words(text: str) -> Column:
    return tokenize(_text(text))


def _weighted(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, word, n): a row per token of ``text``, with the weight of its row."""
    # The outer form keeps Spark from tokenising twice, to test the array for emptiness first.
    words = df.select(*by, F.explode_outer(split_words(_text(text))).alias("word"), "n")
    return words.filter(F.col("word") != "")


def _whole(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    ranked = global_rank(counts, [F.desc("n"), F.asc("word")], "_rank")
    return ranked.select("word", "n", (F.col("_rank") + 1).alias("idx"))


class CorpusStatistics:
    """Word counts, class sizes and the naive Bayes model of the whole joined corpus.

    Rows without a label are not in the corpus. Rows without a token count as rows (``rows``) but not
    as training documents (``documents``). The parts are stored on first use and shared.
    """

    def __init__(self, corpus: Corpus) -> None:
        self.corpus = corpus

    def _spread(self, left: DataFrame, right: DataFrame, key: str, **more) -> DataFrame:
        return spread_left_join(left, right, key, hot_rows=self.corpus.hot_rows, **more)

    @cached_property
    def vendor_fans(self) -> DataFrame:
        """(_product, vendors, silent): rows per mention of a product with vendors, and those of them
        whose vendor has no token."""
        silent = F.when(F.size(_words("vendor")) == 0, F.col("copies")).otherwise(0)
        fans = self.corpus.pairs.groupBy(F.col("product").alias("_product")).agg(
            F.sum("copies").alias("vendors"), F.sum(silent).alias("silent")
        )
        return stage(fans, "vendor-fans")

    @cached_property
    def cve_fans(self) -> DataFrame:
        """(cve_id, n, silent): rows of each CVE with products, and those whose names have no token."""
        named = self._spread(
            self.corpus.named, self.vendor_fans, "_product", left_sizes=self.corpus.product_sizes, right_unique=True
        )
        n = F.col("pcopies") * F.coalesce("vendors", F.lit(1))
        silent = F.col("pcopies") * F.coalesce("silent", F.lit(1))
        quiet = F.when(F.size(_words("_product")) == 0, silent).otherwise(0)
        return stage(named.groupBy("cve_id").agg(F.sum(n).alias("n"), F.sum(quiet).alias("silent")), "cve-fans")

    @cached_property
    def summaries(self) -> DataFrame:
        """(cwe_name, summary, n, silent) of each labelled CVE row. A CVE without products is one row."""
        rows = self.corpus.labelled.select("cve_id", "cwe_name", "summary")
        sized = self._spread(rows, self.cve_fans, "cve_id", right_unique=True)
        return sized.select("cwe_name", "summary", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("silent", F.lit(1)).alias("silent"))

    @cached_property
    def mentions(self) -> DataFrame:
        """(cwe_name, _product, n): mentions of a product by CVE rows of a label."""
        return self._mentions(["cwe_name"])

    def _mentions(self, by: list[str]) -> DataFrame:
        ids = self.corpus.labelled.groupBy("cve_id", *by).agg(F.count(F.lit(1)).alias("rows"))
        met = self._spread(self.corpus.named, ids, "cve_id", right_unique=not by).filter(F.col("rows").isNotNull())
        named = met.groupBy(*by, "_product").agg(F.sum(F.col("pcopies") * F.col("rows")).alias("n"))
        return stage(named, "mentions")

    def _weighted_words(self, mentions: DataFrame, by: list[str]) -> DataFrame:
        """(by, word, n): every token of a summary, product or vendor name, with its weight."""
        by_product = self._spread(mentions, self.vendor_fans, "_product", right_unique=True)
        by_product = by_product.withColumn("n", F.col("n") * F.coalesce("vendors", F.lit(1)))
        pairs = self.corpus.pairs.withColumnRenamed("product", "_product")
        by_vendor = self._spread(mentions, pairs, "_product", right_sizes=self.corpus.vendor_sizes).filter(F.col("vendor").isNotNull())
        by_vendor = by_vendor.groupBy(*by, "vendor").agg(F.sum(F.col("n") * F.col("copies")).alias("n"))
        words = _weighted(self.summaries, by, "summary").unionByName(_weighted(by_product, by, "_product"))
        return words.unionByName(_weighted(by_vendor, by, "vendor"))

    @cached_property
    def counts(self) -> DataFrame:
        """(cwe_name, word, n): how often a word stands in the corpus rows of a label."""
        words = self._weighted_words(self.mentions, ["cwe_name"])
        return stage(words.groupBy("cwe_name", "word").agg(F.sum("n").alias("n")), "corpus-words")

    @cached_property
    def classes(self) -> DataFrame:
        """(cwe_name, rows, documents): corpus rows of a label, and those with a token."""
        silent = F.when(F.size(_words("summary")) == 0, F.col("silent")).otherwise(0)
        sums = self.summaries.groupBy("cwe_name").agg(F.sum("n").alias("rows"), F.sum(silent).alias("silent"))
        return stage(sums.select("cwe_name", "rows", (F.col("rows") - F.col("silent")).alias("documents")), "corpus-classes")

    def word_counts(self) -> DataFrame:
        """(word, n) over all corpus rows. Labels take no part: with them, every word would be counted
        and shuffled once per label that it stands in."""
        return _whole(self._weighted_words(self._mentions([]), []))

    def vocabulary(self) -> DataFrame:
        """(word, n, idx): most frequent first. The joined rows have no order, so ties go by the word."""
        return _ranked(self.word_counts())

    def naive_bayes(
        self, num_words: int = NUM_WORDS, alpha: float = 1.0, min_rows: int = 2
    ) -> tuple[classify.NaiveBayes, DataFrame, DataFrame]:
        """(model, vocabulary, label dictionary), trained with balanced weights on every corpus row
        with a token; labels with fewer than ``min_rows`` of them are left out."""
        vocab = stage(_ranked(_whole(self.counts)), "vocabulary")
        kept = stage(self.classes.filter(F.col("documents") >= min_rows), "kept-classes")
        dictionary = stage(labels.label_dictionary(kept, "cwe_name"), "dictionary")
        weights = labels.class_weights(kept.select(F.col("cwe_name").alias("label"), F.col("documents").alias("n")), "label")
        known = vocab.filter(F.col("idx") < num_words).select("word", F.col("idx").cast("int").alias("idx"))
        coded = self.counts.join(known, "word", "left").withColumn("idx", F.coalesce("idx", F.lit(OOV)))
        cells = coded.groupBy(F.col("cwe_name").alias("label"), "idx").agg(F.sum("n").alias("n"))
        names = dictionary.select("label", F.col("idx").alias("y"))
        cells = stage(cells.join(names, "label").select("y", "idx", "n"), "class-words")
        sizes = cells.groupBy("y").agg(F.sum("n").alias("tokens"))
        docs = names.join(kept.select(F.col("cwe_name").alias("label"), F.col("documents").alias("docs")), "label")
        sizes = docs.join(sizes, "y").select("y", "docs", "tokens")
        model = classify.naive_bayes_of_counts(cells, sizes, dictionary, num_words, alpha, stage(weights, "weights"))
        return model, vocab, dictionary
