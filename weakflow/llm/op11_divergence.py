"""Source divergence audit: how far each source of a language is from the others, and by which words.

The counts of a language are a matrix of sources x kept terms, mostly zeros. It is cut into tiles of
256 x 256, and each tile with a count becomes a k2-tree (k = 2): one bit per quadrant, set where a
quadrant holds a count, level by level, with the counts of the cells in Z-order. Two sources are
compared by walking their trees together. A quadrant that is empty for both has one price, the distance
of their smoothed zeros, times its columns, for all pairs of its rows at once; only where one of the two
has a count does the walk go on, down to single cells.

Sums are exact integers. Counts are combined per slice of text and again before each shuffle, so a hot
source or word is a few rows by then. A tile, and so a task's group, never holds more than 65,536 cells;
the walks of two row tiles are groups of two trees. Sources are numbered within their language and words
within hash buckets of a language; nothing is numbered, summed or broadcast by the driver.

Cases: NULL text, lang and source read as ''. A text without terms, or a group whose words are all rare,
has counts of zero; it is still compared. A language with one source has no pairs; one without kept terms
has pairs of value 0 and no terms. Repeated rows and ids count as often as they occur. Ties rank by the
UTF-8 bytes of the item. Long texts are read whole, one at a time. Only the columns text, lang and source
are read, so others, whatever their names, do not matter. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weakflow.llm import textbytes
from weakflow.operators.joins import broadcast_if_small
from weakflow.sources.staging import stage

#: Terms are runs of ASCII letters and characters beyond ASCII.
LETTERS = textbytes.byte_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
MIN_DOCS = 30  # documents of a language that a kept term needs
TERM_RANKS = 50  # ranks reported of part ``term``
LEVELS = 8  # of a tree; a tile has 2 ** LEVELS rows and columns
WALK = 1 << 15  # pairs of quadrants opened at once
SLICE = 4 << 20
SCALE_STEPS = 3  # 1000 ** 3 is the scale of p

_COUNTED = "lang string, source string, term string, n long, docs long"
_TREE = "lang string, bucket long, tile long, row_tile long, width long, bits binary, counts array<long>"
_WALKED = "lang string, i long, j long, value long, covered long"


def _read(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        for piece in textbytes.slices(batch, "text", SLICE):
            words = textbytes.find_words(piece.column("text"), LETTERS)
            if not len(words.start):
                continue
            coded = words.strings(np.arange(len(words.start))).dictionary_encode()
            size = len(coded.dictionary)
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lang, source = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
            of_source = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = lang.indices.to_numpy(zero_copy_only=False) * len(source.dictionary) + of_source
            text = words.text_of()
            cells, n = np.unique(group[text] * size + term, return_counts=True)
            seen = np.unique(text * size + term)
            _, docs = np.unique(group[seen // size] * size + seen % size, return_counts=True)
            group, term = cells // size, cells % size
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(group // len(source.dictionary))),
                    source.dictionary.take(pa.array(group % len(source.dictionary))),
                    coded.dictionary.take(pa.array(term)),
                    pa.array(n),
                    pa.array(docs),
                ],
                names,
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and its documents there."""
    read = docs.select(_read("lang"), _read("source"), _read("text"))
    counted = read.mapInArrow(_count_batch, _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division with three digits at a time."""
    rest, whole = count + 5, total + 5 * terms
    result = F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        result = result * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return result + 1


def share_array(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays, with ``whole`` = total + 5 terms."""
    rest = count + 5
    result = np.zeros(np.broadcast(count, whole).shape, dtype=np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        result = result * 1000 + rest // whole
        rest = rest % whole
    return result + 1


class Tree:
    """A k2-tree of one tile: ``levels[l]`` holds four bits per node of level l, and ``child[l]`` the
    number of the node that each set bit leads to; nodes of the last level are the cells."""

    def __init__(self, bits: bytes, counts: np.ndarray, levels: int = LEVELS):
        flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))
        self.levels, self.child, self.counts = [], [], counts
        at, nodes = 0, 1
        for _ in range(levels):
            level = flags[at : at + 4 * nodes]
            at += 4 * nodes
            self.levels.append(level)
            self.child.append(np.cumsum(level, dtype=np.int64) - 1)
            nodes = int(level.sum())

    def step(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The nodes below the given ones, or -1 where the quadrant is empty (also below -1)."""
        place = 4 * np.maximum(node, 0) + quadrant
        there = (node >= 0) & (self.levels[level][place] > 0)
        return np.where(there, self.child[level][place], -1)


def _interleave(row: np.ndarray, column: np.ndarray, levels: int) -> np.ndarray:
    code = np.zeros(len(row), dtype=np.int64)
    for bit in range(levels):
        code |= ((row >> bit) & 1) << (2 * bit + 1) | ((column >> bit) & 1) << (2 * bit)
    return code


def build_tree(row: np.ndarray, column: np.ndarray, count: np.ndarray, levels: int = LEVELS) -> tuple[bytes, np.ndarray]:
    """The bits of a tile's tree and its counts in Z-order."""
    code = _interleave(row, column, levels)
    order = np.argsort(code)
    code = code[order]
    parents, bits = np.zeros(1, dtype=np.int64), []
    for level in range(1, levels + 1):
        nodes = np.unique(code >> (2 * (levels - level)))
        level_bits = np.zeros(4 * len(parents), dtype=np.uint8)
        level_bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = 1
        bits.append(level_bits)
        parents = nodes
    return np.packbits(np.concatenate(bits)).tobytes(), count[order]


def walk(
    a: Tree | None,
    b: Tree | None,
    same: bool,
    whole_a: np.ndarray,
    whole_b: np.ndarray,
    width: int,
    levels: int = LEVELS,
) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) -> the summed distances of rows i of one row tile and j of another over a column tile.

    ``same`` says that both are the same tile, so that only i < j is wanted. None is an empty tile.
    The second result marks the pairs that were compared.
    """
    rows_a, rows_b, tile = len(whole_a), len(whole_b), 1 << levels
    cells = np.zeros(tile * tile)
    empty_columns = np.zeros((tile, tile), dtype=np.int64)
    zero = np.zeros(1, dtype=np.int64)
    todo = [(0, zero if a else zero - 1, zero if b else zero - 1, zero, zero, zero)]
    while todo:
        level, *front = todo.pop()
        if len(front[0]) > WALK:
            todo.append((level, *[x[WALK:] for x in front]))
            front = [x[:WALK] for x in front]
        node_a, node_b, at_a, at_b, column = front
        half = tile >> (level + 1)
        blocks = tile // half
        priced = np.zeros(blocks * blocks)
        opened = []
        for q in range(8):
            low_a, low_b, right = q >> 2, q >> 1 & 1, q & 1
            ia, ib, c = at_a + low_a * half, at_b + low_b * half, column + right * half
            inside = (ia < rows_a) & (ib < rows_b) & (c < width)
            if same:
                inside &= ia <= ib if half > 1 else ia < ib
            if not inside.any():
                continue
            ia, ib, c = ia[inside], ib[inside], c[inside]
            na = a.step(level, node_a[inside], 2 * low_a + right) if a else np.full(len(ia), -1)
            nb = b.step(level, node_b[inside], 2 * low_b + right) if b else np.full(len(ia), -1)
            void = (na < 0) & (nb < 0)
            if void.any():
                block = ia[void] // half * blocks + ib[void] // half
                priced += np.bincount(block, np.minimum(half, width - c[void]), blocks * blocks)
            if not void.all():
                opened.append([x[~void] for x in (na, nb, ia, ib, c)])
        if priced.any():
            grown = priced.astype(np.int64).reshape(blocks, blocks)
            empty_columns += grown.repeat(half, axis=0).repeat(half, axis=1)
        if not opened:
            continue
        front = [np.concatenate(x) for x in zip(*opened)]
        if level + 1 < levels:
            todo.append((level + 1, *front))
            continue
        na, nb, ia, ib, _ = front
        count_a = np.where(na >= 0, a.counts[np.maximum(na, 0)], 0) if a else np.zeros(len(ia), dtype=np.int64)
        count_b = np.where(nb >= 0, b.counts[np.maximum(nb, 0)], 0) if b else np.zeros(len(ia), dtype=np.int64)
        gap = np.abs(share_array(count_a, whole_a[ia]) - share_array(count_b, whole_b[ib]))
        cells += np.bincount(ia * tile + ib, gap, tile * tile)
    nought_a, nought_b = (share_array(np.zeros(len(w), dtype=np.int64), w) for w in (whole_a, whole_b))
    value = cells.astype(np.int64).reshape(tile, tile)[:rows_a, :rows_b]
    value = value + empty_columns[:rows_a, :rows_b] * np.abs(nought_a[:, None] - nought_b[None, :])
    wanted = np.ones((rows_a, rows_b), dtype=bool)
    return value, np.triu(wanted, 1) if same else wanted


def _build_group(cells: pa.Table, levels: int) -> pa.Table:
    row, column, n = (cells.column(c).to_numpy() for c in ("r", "c", "n"))
    bits, counts = build_tree(row, column, n, levels)
    key = cells.slice(0, 1).select(["lang", "bucket", "tile", "row_tile", "width"])
    key = key.append_column("bits", pa.array([bits], pa.binary()))
    return key.append_column("counts", pa.array([counts], pa.list_(pa.int64())))


def _walk_group(trees: pa.Table, levels: int) -> pa.Table:
    rows = {t["row_tile"]: t for t in trees.to_pylist()}
    one = next(iter(rows.values()))
    a, b = one["a"], one["b"]
    whole_a, whole_b = (np.array(one[c], dtype=np.int64) for c in ("whole_a", "whole_b"))

    def tree(of: int) -> Tree | None:
        return Tree(rows[of]["bits"], np.array(rows[of]["counts"], dtype=np.int64), levels) if of in rows else None

    first = tree(a)
    value, wanted = walk(first, first if a == b else tree(b), a == b, whole_a, whole_b, one["width"], levels)
    i, j = np.nonzero(wanted)
    columns = [pa.array([one["lang"]] * len(i), pa.string()), pa.array(i + (a << levels)), pa.array(j + (b << levels))]
    columns += [pa.array(value[i, j]), pa.array(np.full(len(i), one["width"], dtype=np.int64))]
    return pa.Table.from_arrays(columns, ["lang", "i", "j", "value", "covered"])


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def trees(cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One k2-tree per tile from (lang, bucket, tile, row_tile, width, r, c, n)."""
    wanted = cells.select("lang", "bucket", "tile", "row_tile", "width", "r", "c", "n")
    return wanted.groupBy("lang", "bucket", "tile", "row_tile").applyInArrow(lambda t: _build_group(t, levels), _TREE)


def pair_sums(forest: DataFrame, groups: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(lang, i, j, value, covered) for sources i < j: distance over the columns of their tiles, and
    how many columns those are."""
    whole = F.col("total") + 5 * F.col("terms")
    sides = groups.groupBy("lang", "row_tile").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", whole.alias("whole")))), lambda s: s["whole"]).alias("wholes")
    )
    sides = stage(sides, "sources")
    tiles = broadcast_if_small(sides.groupBy("lang").agg(F.max("row_tile").alias("last")))
    paired = forest.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    paired = paired.withColumns({"a": F.least("row_tile", "other"), "b": F.greatest("row_tile", "other")})
    for side in "ab":
        one = sides.select("lang", F.col("row_tile").alias(side), F.col("wholes").alias(f"whole_{side}"))
        paired = paired.join(broadcast_if_small(one), ["lang", side])
    met = paired.drop("last", "other").groupBy("lang", "bucket", "tile", "a", "b")
    walked = met.applyInArrow(lambda t: _walk_group(t, levels), _WALKED)
    return walked.groupBy("lang", "i", "j").agg(_sum("value"), _sum("covered"))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int | None = TERM_RANKS, levels: int = LEVELS
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by
    distance, part ``term`` the words that a source uses more than its language. A hash bucket of words
    fills half a tile on average; a fuller one is cut into several tiles."""
    side_of_tile = F.lit(1 << levels).cast("long")
    counted = stage(term_counts(docs), "term-counts")
    kept = counted.groupBy("lang", "term").agg(_sum("docs"), F.sum("n").alias("in_lang"))
    kept = stage(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    langs = stage(langs, "languages")

    buckets = F.ceil(F.col("terms") * 2 / side_of_tile).cast("long")
    bucketed = kept.join(broadcast_if_small(langs), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), buckets))
    in_bucket = Window.partitionBy("lang", "bucket")
    place = F.row_number().over(in_bucket.orderBy("term")).cast("long") - 1
    tile = F.call_function("div", F.col("place"), side_of_tile)
    terms = bucketed.withColumns({"place": place, "filled": F.count(F.lit(1)).over(in_bucket)})
    terms = terms.withColumns({"tile": tile, "c": F.col("place") % side_of_tile})
    terms = terms.withColumn("width", F.least(side_of_tile, F.col("filled") - F.col("tile") * side_of_tile))
    terms = terms.select("lang", "term", "in_lang", "bucket", "tile", "c", "width")

    cells = stage(counted.drop("docs").join(terms, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_read("lang"), _read("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = groups.withColumn("g", number)
    groups = groups.withColumns(
        {"row_tile": F.call_function("div", F.col("g"), side_of_tile), "r": F.col("g") % side_of_tile}
    )
    groups = stage(groups, "groups")
    placed = cells.join(broadcast_if_small(groups), ["lang", "source"])

    sums = pair_sums(stage(trees(placed, levels), "trees"), groups.filter("terms > 0"), levels)
    nought = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    side = groups.select("lang", "source", "g", "terms", nought.alias("nought"))
    left = side.select("lang", F.col("source").alias("x"), F.col("g").alias("i"), "terms", F.col("nought").alias("nx"))
    right = side.select("lang", F.col("source").alias("y"), F.col("g").alias("j"), F.col("nought").alias("ny"))
    met = left.join(right, "lang").filter("i < j").join(sums, ["lang", "i", "j"], "left").fillna(0, ["value", "covered"])
    unmet = (F.col("terms") - F.col("covered")) * F.abs(F.col("nx") - F.col("ny"))
    both = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    pairs = met.select("lang", F.explode(both).alias("s"), (F.col("value") + unmet).alias("value"))
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    over = placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    words = over.filter("value > 0").select("*", rank)
    if term_ranks is not None:
        words = words.filter(F.col("rank") <= term_ranks)
    return pairs.select("*", rank).unionByName(words)
