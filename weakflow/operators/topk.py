"""The best classes of a text among very many, without a score for every class.

The score of class y is ``prior[y] + len * base[y] + sum(n * delta[word, y])`` with deltas above zero,
so the threshold algorithm applies. Every word has its classes sorted by delta; the classes of a text's
words are read from the top of these lists, and each class met is scored exactly by looking up all words
of the text. What has not been met scores at most the next delta of each list plus the next
``prior + len * base``. Once the best ``top`` classes all lie above that threshold, the rest need not be
looked at. Equal scores go by class number, so reading goes on while a tie is possible.

A model travels as sorted lists of its cells, in shards of whole classes with a bounded number of cells;
each shard is sent to the tasks once and its best classes are merged with those of the shards before.
So any number of classes works in the same way, for tables and for streams, inside the scan: there is no
table of words x classes, no row per text and class, and no shuffle.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.operators.classify import NaiveBayes
from weakflow.sources.staging import stage

SHARD_CELLS = 4_000_000  # cells sent to the tasks at once (28 bytes each)
FIRST = 16  # classes of each list that are read first; then four times as many
KEPT_LENGTHS = 256  # text lengths whose order of ``prior + len * base`` is remembered


@dataclass
class Shard:
    """Some classes with their cells, twice: as (word, class) keys for look-ups, and as lists by delta."""

    ys: np.ndarray
    prior: np.ndarray
    base: np.ndarray
    words: np.ndarray  # the words that have a list
    starts: np.ndarray  # where the list of each word begins; one more than words
    keys: np.ndarray  # word place * classes + class place, ascending
    deltas: np.ndarray  # in the order of the keys
    list_class: np.ndarray  # class places, per word by delta, greatest first
    list_delta: np.ndarray
    lengths: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def statics(self, size: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(prior + size * base, places of its greatest values in order, ``upto`` of them at least)."""
        known = self.lengths.get(size)
        if known is None or len(known[1]) < min(upto, len(self.ys)):
            value = self.prior + size * self.base
            if upto >= len(value):
                order = np.argsort(-value, kind="stable")
            else:
                order = np.argpartition(-value, upto)[: upto + 1]
                order = order[np.argsort(-value[order], kind="stable")]
            if len(self.lengths) >= KEPT_LENGTHS:
                self.lengths.clear()
            known = self.lengths[size] = (value, order)
        return known

    def look_up(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The sum of n * delta over the words for each of the classes."""
        wanted = (words[:, None] * len(self.ys) + classes[None, :]).ravel()
        place = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        found = np.where(self.keys[place] == wanted, self.deltas[place], 0) if len(self.keys) else np.zeros(len(wanted), dtype=np.int64)
        return (found.reshape(len(words), len(classes)) * counts[:, None]).sum(axis=0)

    def best(self, ids: np.ndarray, top: int) -> tuple[list[tuple[int, int]], int]:
        """The ``top`` best (score, y), and how many classes were scored."""
        size, classes = len(ids), len(self.ys)
        listed, counts = np.unique(ids, return_counts=True)
        place = np.searchsorted(self.words, listed)
        known = place < len(self.words)
        known[known] = self.words[place[known]] == listed[known]
        words, counts = place[known], counts[known].astype(np.int64)
        begin, end = self.starts[words], self.starts[words + 1]
        scored = np.empty(0, dtype=np.int64)
        scores = np.empty(0, dtype=np.int64)
        depth = FIRST
        while True:
            value, order = self.statics(size, depth)
            until = np.minimum(begin + depth, end)
            fresh = [self.list_class[a:b] for a, b in zip(begin, until)]
            fresh = np.setdiff1d(np.concatenate([order[:depth], *fresh]), scored)
            scored = np.concatenate([scored, fresh])
            scores = np.concatenate([scores, value[fresh] + self.look_up(words, counts, fresh)])
            if len(scored) == classes:
                break
            more = until < end
            rest = value[order[depth]] if depth < classes else np.iinfo(np.int64).min // 2
            bound = rest + (self.list_delta[until[more]] * counts[more]).sum()
            if len(scores) >= top and np.partition(scores, -top)[-top] > bound:
                break
            depth *= 4
        chosen = np.lexsort((self.ys[scored], -scores))[:top]
        return [(int(scores[i]), int(self.ys[scored[i]])) for i in chosen], len(scored)


def shard_of(classes: pa.Table, cells: pa.Table) -> Shard:
    """From (y, prior, base) and (y, idx, delta) rows in any order."""
    classes = classes.sort_by("y")
    ys = classes["y"].to_numpy().astype(np.int64)
    idx, delta = cells["idx"].to_numpy().astype(np.int64), cells["delta"].to_numpy().astype(np.int64)
    of_class = np.searchsorted(ys, cells["y"].to_numpy())
    words, word = np.unique(idx, return_inverse=True)
    key = word * len(ys) + of_class
    by_key, by_delta = np.argsort(key), np.lexsort((of_class, -delta, word))
    starts = np.searchsorted(word[by_delta], np.arange(len(words) + 1))
    prior, base = (classes[c].to_numpy().astype(np.int64) for c in ("prior", "base"))
    lists = of_class[by_delta].astype(np.int32), delta[by_delta]
    return Shard(ys, prior, base, words, starts, key[by_key], delta[by_key], *lists)


def _shards(model: NaiveBayes, shard_cells: int) -> tuple[DataFrame, DataFrame, int]:
    """(classes with ``shard``, cells with ``shard``, number of shards)."""
    sizes = model.cells.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    sized = model.classes.join(sizes, "y", "left").fillna(0, ["n"])
    # Classes count as cells, too, and the windows run over the class table.
    whole = F.sum(F.col("n") + 1).over(Window.orderBy("y"))
    numbered = sized.withColumn("shard", F.floor((whole - 1) / shard_cells).cast("int"))
    numbered = stage(numbered.select("y", "prior", "base", "shard"), "class-shards")
    cells = stage(model.cells.join(numbered.select("y", "shard"), "y"), "cell-shards")
    return numbered, cells, (numbered.agg(F.max("shard")).first()[0] or 0) + 1


_KIND = "array<struct<y:int,score:bigint>>"


def _better_of(shared: Broadcast, top: int) -> Callable[..., Column]:
    """A function of (ids, best so far) that lets the classes of a shard compete."""

    @F.arrow_udf(_KIND)
    def better(ids: pa.Array, best: pa.Array) -> pa.Array:
        found = []
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        words = ids.flatten().to_numpy(zero_copy_only=False)  # of all rows; a NULL row has none
        for size, end, before in zip(sizes, ends, best):
            rivals, _ = shared.value.best(words[end - size : end].astype(np.int64), top)
            rivals += [(b["score"], b["y"]) for b in before.as_py()]
            rivals.sort(key=lambda r: (-r[0], r[1]))
            found.append([{"y": y, "score": score} for score, y in rivals[:top]])
        return pa.array(found, pa.list_(pa.struct([("y", pa.int32()), ("score", pa.int64())])))

    # The mark keeps it a step of its own; Spark cannot run it inside an array expression.
    return better.asNondeterministic()


def top_classes(df: DataFrame, model: NaiveBayes, top: int = 3, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """Adds ``best``, the ``top`` best classes as an array of (y, score): score down, y up.

    Rows have ``ids``; NULL counts as no words. ``df`` may be a stream. A model without classes gives
    empty arrays.
    """
    classes, cells, shards = _shards(model, shard_cells)
    out = df.withColumn("best", F.expr(f"CAST(array() AS {_KIND})"))
    for number in range(shards):
        of_shard = F.col("shard") == number
        shard = shard_of(classes.filter(of_shard).toArrow(), cells.filter(of_shard).toArrow())
        if not len(shard.ys):
            continue
        better = _better_of(df.sparkSession.sparkContext.broadcast(shard), top)
        out = out.withColumn("best", better("ids", "best"))
        if number + 1 < shards and not df.isStreaming:
            out = stage(out, "best-classes")  # one shard at a time is in memory
    return out
