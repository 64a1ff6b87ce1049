"""Benchmark decontamination with a distributed positional inverted index.

Building: every task turns its texts into index segments of a few megabytes. A segment holds
its terms in hash order with their bytes, and for each term the sorted places where it stands
(words are numbered through the segment, with a gap between texts, so that no phrase can
cross from one text into the next). Segments are rows of a Parquet table in the shared folder:
the index grows with the corpus, is never shuffled, and a lost task writes its part again.

Searching: the test items are sent to the tasks in blocks of at most ``BLOCK_BYTES``, however
many there are; every block is searched in every segment, one block after the other, and only
one is held. A text is known by its segment and its place there, which the index stores, so the
hits of several blocks meet whatever the plan of each search. For each phrase the place lists of
its terms are intersected, shifted by their offset in the phrase, beginning with the rarest
term of that segment. ``phrase_starts`` finds exact phrases, ``proximity_matches`` places
where all terms of a phrase stand within a window of words. Terms are compared by their
bytes, so results are exact.

NULL or empty texts have no words and no hits; items without text occur nowhere. Items without an
id count for the hits, but cannot be listed or counted among the items. Rows with the same id stay separate rows of the result. Empty tables give no rows, or
rows without hits.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakflow.llm import textbytes as tb
from weakflow.sources.staging import new_path, stage

WINDOW = 13
MIN_SHARE = 20  # a document is contaminated if at least one word in 20 is hit
BLOCK_BYTES = 8 << 20
SEGMENTS_PER_FILE = 8
_GAP = 1 << 10  # numbers left free between two texts; longer than any phrase or window

SEGMENT = (
    "segment string, ids binary, n_words binary, begin binary, term_hash binary, term_at binary, term_bytes binary, "
    "list_at binary, places binary"
)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _segment(ids: pa.Array, texts: pa.Array, gap: int) -> dict[str, bytes]:
    words = tb.find_words(texts, tb.ALPHANUMERIC)
    counts = words.counts()
    begin = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts + gap, out=begin[1:])
    place = np.arange(len(words.start)) + np.repeat(begin[:-1] - words.first[:-1], counts)
    hashes = words.hashes()
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    list_at = np.append(np.flatnonzero(new), len(ordered))
    firsts = order[list_at[:-1]]
    terms = tb.spans_as_binary(words.data, words.start[firsts], words.end[firsts])
    _, term_at, term_bytes = terms.buffers()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as writer:
        writer.write_batch(pa.record_batch([ids], names=["id"]))
    return {
        "ids": sink.getvalue().to_pybytes(),
        "n_words": _bytes(counts.astype(np.int64)),
        "begin": _bytes(begin),
        "term_hash": _bytes(ordered[new]),
        "term_at": _bytes(np.frombuffer(term_at, dtype=np.int64)[: len(firsts) + 1].astype(np.int32)),
        "term_bytes": term_bytes.to_pybytes() if term_bytes is not None else b"",
        "list_at": _bytes(list_at.astype(np.int32)),
        "places": _bytes(place[order].astype(np.uint32)),
    }


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", gap: int = _GAP) -> DataFrame:
    """The stored segments of the index over all rows of ``df``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        schema = pa.schema([(name, pa.binary() if i else pa.string()) for i, name in enumerate(names)])
        partition, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for piece in tb.slices(batch, "text"):
                n += 1
                rows.append({"segment": f"{partition}-{n}", **_segment(piece.column(0), piece.column(1), gap)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    pairs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    path = new_path(df.sparkSession, "positions")
    # Few segments per file: readers decode the rows of a file together.
    pairs.mapInArrow(lambda b: tb.tidy(segments(b)), SEGMENT).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(SEGMENT).parquet(path)


class Segment:
    """One segment, read back for searching."""

    def __init__(self, row: dict) -> None:
        self.name = row.get("segment")
        self.ids = pa.ipc.open_stream(row["ids"]).read_all()["id"].combine_chunks()
        self.n_words = np.frombuffer(row["n_words"], dtype=np.int64)
        self.begin = np.frombuffer(row["begin"], dtype=np.int64)
        self.hash = np.frombuffer(row["term_hash"], dtype=np.uint64)
        self.term_at = np.frombuffer(row["term_at"], dtype=np.int32)
        self.term_bytes = row["term_bytes"]
        self.list_at = np.frombuffer(row["list_at"], dtype=np.int32)
        self.places = np.frombuffer(row["places"], dtype=np.uint32)

    def find_terms(self, hashes: np.ndarray, terms: list[bytes]) -> np.ndarray:
        """Number of each term in this segment, -1 if it does not occur."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        found = np.where(self.hash[at] == hashes, at, -1)
        for i in np.flatnonzero(found >= 0):
            lo, hi = self.term_at[found[i]], self.term_at[found[i] + 1]
            if self.term_bytes[lo:hi] != terms[i]:
                found[i] = -1
        return found

    def frequency(self, term: np.ndarray) -> np.ndarray:
        return self.list_at[term + 1] - self.list_at[term]

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.list_at[term] : self.list_at[term + 1]]


def _among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    values = values.astype(np.uint32)
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values


def phrase_starts(segment: Segment, terms: np.ndarray) -> np.ndarray:
    """Places where the terms stand one after the other: offset-adjusted lists, rarest first."""
    order = np.argsort(segment.frequency(terms), kind="stable")
    starts = segment.list_of(terms[order[0]]).astype(np.int64) - order[0]
    starts = starts[starts >= 0]
    for j in order[1:]:
        if not len(starts):
            break
        starts = starts[_among(starts + j, segment.list_of(terms[j]))]
    return starts


def proximity_matches(segment: Segment, terms: np.ndarray, within: int) -> np.ndarray:
    """Places of the rarest term with every other term at most ``within`` words away."""
    order = np.argsort(segment.frequency(terms), kind="stable")
    places = segment.list_of(terms[order[0]]).astype(np.int64)
    for j in order[1:]:
        other = segment.list_of(terms[j]).astype(np.int64)
        at = np.searchsorted(other, places)
        left = np.abs(places - other[np.maximum(at - 1, 0)])
        right = np.abs(other[np.minimum(at, len(other) - 1)] - places)
        places = places[np.minimum(left, right) <= within]
    return places


class Phrases:
    """The windows of a block of test items, as numbers of distinct terms."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        words = tb.find_words(pa.array([t for _, t in items], pa.string()), tb.ALPHANUMERIC)
        terms = tb.spans_as_binary(words.data, words.start, words.end).to_pylist()
        self.terms = sorted(set(terms))
        number = {t: i for i, t in enumerate(self.terms)}
        joined = tb.find_words(pa.array([b" ".join(self.terms)]).cast(pa.string()), tb.ALPHANUMERIC)
        self.hashes = joined.hashes()
        self.items: list[str | None] = [name for name, _ in items]
        sequences: dict[tuple[int, ...], list[int]] = {}
        for i in range(len(items)):
            own = [number[t] for t in terms[words.first[i] : words.first[i + 1]]]
            for at in range(max(1, len(own) - window + 1) if own else 0):
                of = sequences.setdefault(tuple(own[at : at + window]), [])
                if not of or of[-1] != i:
                    of.append(i)
        self.windows = list(sequences)
        self.owners = list(sequences.values())
        width = max((len(w) for w in self.windows), default=1)
        self.grid = np.full((len(self.windows), width), len(self.terms))
        for i, w in enumerate(self.windows):
            self.grid[i, : len(w)] = w


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items with words, in blocks of bounded size, fetched one partition at a time."""
    rows = items.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["id"], row["text"]))
        size += len(row["text"].encode()) + len(row["id"] or "") + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, phrases: Phrases, key_type: str, proximity: int = 0) -> DataFrame:
    """(segment-wise) rows (segment, at, id, n_words, hit_words, items): one per text of the index.

    ``hit_words`` lists the numbers of the words inside any occurrence of a phrase; with
    ``proximity`` it lists the places of proximity matches instead.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                yield _found(Segment(row), asked, proximity)

    schema = f"segment string, at int, id {key_type}, n_words long, hit_words array<long>, items array<string>"
    return index.mapInArrow(lambda b: tb.tidy(matches(b)), schema)


def _found(segment: Segment, asked: Phrases, proximity: int) -> pa.RecordBatch:
    n = len(segment.n_words)
    term = np.append(segment.find_terms(asked.hashes, asked.terms), -2)
    grid = term[asked.grid]
    possible = np.flatnonzero((grid != -1).all(axis=1) & (grid[:, 0] != -2)) if len(grid) else []
    spans: list[np.ndarray] = []
    by_text: dict[int, set[str]] = {}
    for w in possible:
        terms = grid[w][grid[w] >= 0]
        if proximity:
            starts, size = proximity_matches(segment, terms, proximity), 1
        else:
            starts, size = phrase_starts(segment, terms), len(terms)
        if not len(starts):
            continue
        spans.append((starts[:, None] + np.arange(size)).ravel())
        for text in np.unique(np.searchsorted(segment.begin, starts, "right") - 1):
            by_text.setdefault(int(text), set()).update(
                asked.items[i] for i in asked.owners[w] if asked.items[i] is not None
            )
    hits = np.unique(np.concatenate(spans)) if spans else np.empty(0, dtype=np.int64)
    text = np.searchsorted(segment.begin, hits, "right") - 1
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits - segment.begin[text]))
    items = pa.array([sorted(by_text.get(i, ())) for i in range(n)], pa.list_(pa.string()))
    where = [pa.array([segment.name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32))]
    return pa.RecordBatch.from_arrays(
        [*where, segment.ids, pa.array(segment.n_words), words, items],
        names=["segment", "at", "id", "n_words", "hit_words", "items"],
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``docs``."""
    if not 0 < window < _GAP:
        raise ValueError("a window must be shorter than the gap between texts")
    kind = docs.schema[key].dataType.simpleString()
    index = build_index(docs, key, text)
    blocks = _blocks(items, item_key, item_text)
    merged = search(index, Phrases(next(blocks, []), window), kind)
    following = next(blocks, None)
    if following is not None:
        # The first search gives all texts; of the others only hits are stored.
        merged = stage(merged, "hits")
        while following is not None:
            hits = search(index, Phrases(following, window), kind).filter(F.size("hit_words") > 0)
            merged = merged.unionByName(stage(hits, "hits"))
            following = next(blocks, None)
        merged = merged.groupBy("segment", "at").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    n_hit = F.size("hit_words").cast("long")
    names = F.array_join(F.array_sort("items"), ",")
    return merged.select(
        F.col("id").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
