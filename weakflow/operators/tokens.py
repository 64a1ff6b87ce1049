"""Vocabulary building and sequence encoding."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from weakflow.functions.text import pad_post
from weakflow.operators.joins import broadcast_if_small
from weakflow.operators.ranks import global_rank
from weakflow.sources.staging import stage

OOV = 1  # index of unknown words; 0 is padding; words start at 2
NUM_WORDS = 10_000  # words with an index of their own when encoding; the others are unknown
_LOOKED_UP = 1 << 18  # tokens looked up at once while encoding
MAX_NUM_WORDS = 1_000_000  # bound of the words that are sent to the tasks


def drop_empty_sequences(df: DataFrame, tokens: str = "ids") -> DataFrame:
    return df.filter(F.size(tokens) > 0)


def _exploded(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, _pos, word). The outer form keeps Spark from testing the array for emptiness
    first, which would tokenize each text again."""
    words = df.select(doc, F.posexplode_outer(tokens).alias("_pos", "word"))
    return words.filter(F.col("word").isNotNull())


def word_counts(df: DataFrame, doc: str, tokens: str = "tokens") -> DataFrame:
    """(word, n, first_doc, first_pos): frequency and first appearance in document order.

    Any unique key that can be sorted names the documents. A whole number is packed with the
    position into one number, which a hash aggregate can keep as a running minimum; frequent
    words are combined before the shuffle. Other keys are numbered in their order first, since a
    minimum of theirs would have all tokens sorted.
    """
    if isinstance(df.schema[doc].dataType, IntegralType):
        named = df.withColumnRenamed(doc, "_doc")
        least, most = named.agg(F.min("_doc"), F.max("_doc")).first()
        narrow = least is None or (least >= -(1 << 31) and most < 1 << 31)
        return _counted(_exploded(named, "_doc", F.col(tokens)), narrow)
    keys = df.select(F.col(f"`{doc}`").alias("_key")).distinct()
    numbers = stage(global_rank(keys, [F.asc("_key")], "_doc"), "document-numbers")
    rows = df.select(F.col(f"`{doc}`").alias("_own"), F.col(tokens).alias("_tokens"))
    numbered = rows.join(broadcast_if_small(numbers), F.col("_own").eqNullSafe(F.col("_key")))
    counted = stage(_counted(_exploded(numbered, "_doc", F.col("_tokens"))), "word-counts")
    named = counted.join(numbers, F.col("first_doc") == F.col("_doc"))
    return named.select("word", "n", F.col("_key").alias("first_doc"), "first_pos")


def _counted(word_at: DataFrame, narrow: bool = False) -> DataFrame:
    """(word, n, first_doc, first_pos) of (_doc, _pos, word), where ``_doc`` is a whole number. A ``narrow``
    one has 32 bits and is packed into a long; any other into a decimal, which takes longer to add up."""
    if narrow:
        packed = F.shiftleft(F.col("_doc").cast("long"), 32).bitwiseOR(F.col("_pos").cast("long"))
        counted = word_at.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(packed).alias("_first"))
        pos = F.col("_first").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return counted.select("word", "n", F.shiftright("_first", 32).alias("first_doc"), pos.alias("first_pos"))
    packed = F.col("_doc").cast("decimal(20,0)") * (1 << 32) + F.col("_pos")
    span = F.lit(1 << 32).cast("decimal(20,0)")
    counted = word_at.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(packed).alias("_first"))
    pos = F.pmod(F.col("_first"), span)
    return counted.select(
        "word",
        "n",
        ((F.col("_first") - pos) / span).cast("long").alias("first_doc"),
        pos.cast("int").alias("first_pos"),
    )


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, n, idx) of all words: most frequent first, ties by first appearance. ``idx`` has 64 bits."""
    order = [F.desc("n"), F.asc("first_doc"), F.asc("first_pos")]
    ranked = global_rank(counts, order, "_rank")
    return ranked.select("word", "n", (F.col("_rank") + 1).alias("idx"))


def encode_sequences(
    df: DataFrame, vocab: DataFrame, tokens: str = "tokens", num_words: int = NUM_WORDS
) -> DataFrame:
    """Adds ``ids``: the index of each token, of the whole text, inside the scan of ``df``.

    Only words with ``idx < num_words`` have their own index, so what is sent to the tasks is
    bounded by that parameter, whatever the size of the stored vocabulary. Arrow looks up a
    whole batch of tokens in one call; joining would shuffle every token of every row.
    """
    if num_words > MAX_NUM_WORDS:
        raise ValueError(f"num_words is at most {MAX_NUM_WORDS}")
    listed = vocab.filter(F.col("idx") < num_words).select("word", "idx").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((listed["word"], listed["idx"].to_numpy()))

    @F.arrow_udf("array<int>")
    def index_of(words: pa.Array) -> pa.Array:
        known, indexes = shared.value
        # The place after the last known word stands for all unknown ones.
        table, flat = np.append(indexes, OOV).astype(np.int32), words.flatten()
        ids = np.empty(len(flat), dtype=np.int32)
        for lo in range(0, len(flat), _LOOKED_UP):
            some = flat.slice(lo, _LOOKED_UP)
            places = pc.fill_null(pc.index_in(some, value_set=known), len(known))
            ids[lo : lo + _LOOKED_UP] = table[places.to_numpy(zero_copy_only=False)]
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))

    # The mark keeps it a step of its own; Spark cannot run it inside an array expression.
    return df.withColumn("ids", index_of.asNondeterministic()(F.col(tokens)))


def pad_sequences(df: DataFrame, max_len: int = 300) -> DataFrame:
    """Adds ``padded``: exactly ``max_len`` ids; this is where longer sequences are cut."""
    return df.withColumn("padded", pad_post(F.col("ids"), max_len))
