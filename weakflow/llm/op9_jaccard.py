"""N-gram Jaccard join by T-occurrence search over inverted lists.

The set of a text is its distinct five-word shingles (hashed to 64 bits). Two texts link when
they share at least T = ceil(0.8 * (|a| + |b|) / 1.8) shingles, which is a Jaccard similarity
of 0.8 or more. Texts with equal sets are one class and link without a search.

Finding candidates. The inverted lists of a text are put in one global order, short lists
first (their length is estimated by a count sketch of fixed size over all texts; the estimate
only orders, it never decides). If two texts share T shingles, they share ``k`` of them among
the first |a| - T + k of that order. So only these short lists are merged: postings are
dealt out by shingle, and lists with more than one text give candidates.
  Round 1 takes, per list and band of set sizes, the pairs of each text with the first one.
  Round 2 takes, of all lists that still hold texts of different components, the pairs from
  different components, counts them over the lists, and keeps those with at least k. Of a
  pair that shares T, each of its first k common shingles has at least T - k + 1 shingles of
  either text from its place on; meetings later than that are not counted.
Pairs inside one component need no test, so large groups of near copies cost one pair per
text and list, not all pairs.

Deciding. The candidates of a query text form a small index. DivideSkip sets aside its T - k
longest lists, heap-merges the short ones, and binary-probes the long ones for the candidates
that can still reach T. Groups are cut at about ``GROUP_BYTES`` of candidates.

Hot lists are dealt out in parts of about ``PART_ROWS`` postings, with a pivot in each part and
links between the pivots. An empty or NULL text has no set and links with nothing; a text of
fewer than five words has one shingle, the whole. Rows without an id are returned without a
component. Rows that share an id are one document with several texts. Extra columns are not
read.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakflow.llm import textbytes as tb
from weakflow.llm.graph import components
from weakflow.sources.staging import stage

SHINGLE = 5
PERCENT = 80
K = 3  # short lists that a pair has to share
SLOTS = 1 << 22  # counters of the sketch
GROUP_BYTES = 4 << 20
PART_ROWS = 100_000
MAX_BROADCAST_IDS = 1_000_000
POSTINGS_HELD = 1 << 18  # postings that a task holds before it passes them on
POSTED_SETS = 200_000  # sets that a task remembers, so as not to post a copy; forgetting costs time only
PIECE_BYTES = 1 << 18  # text cut into shingles at once; each byte takes some 40 more while it is hashed
_BLOCK = 4096
_BLOCKS_SENT = 64  # blocks of the sketch that leave a task together


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text begins."""
    words = tb.find_words(texts, tb.NOT_SPACE)
    hashes, at = tb.window_hashes(words.hashes(), words.first, size)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(at))
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.uint32), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def required(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shared shingles that two sets of these sizes need."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % SLOTS


def signatures(df: DataFrame) -> DataFrame:
    """Rows of two kinds: (id, n, s1, s2) of each text, and (block, counts) of the sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, dtype=np.uint32)
        names = ["id", "n", "s1", "s2", "block", "counts"]
        for batch in batches:
            for piece in tb.slices(batch, "text", PIECE_BYTES):
                hashes, at = shingle_sets(piece.column("text"))
                np.add.at(sketch, _slot(hashes), np.uint32(1))
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(_sums(hashes, at)),
                        pa.array(_sums(tb.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
        for lo in range(0, SLOTS // _BLOCK, _BLOCKS_SENT):
            numbers = range(lo, min(lo + _BLOCKS_SENT, SLOTS // _BLOCK))
            blocks = [sketch[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in numbers]
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], names=names
            )

    return df.mapInArrow(lambda b: tb.tidy(rows(b)), "id long, n long, s1 long, s2 long, block int, counts binary")


def sketch_of(signed: DataFrame) -> np.ndarray:
    """The summed sketch: SLOTS counters, whatever the number of texts."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, dtype=np.uint64)
        for c in group["counts"]:
            raw = c.as_py()
            total += np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * _BLOCK else np.uint64)
        return pa.table({"block": group["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = signed.filter("block IS NOT NULL").select(
        "block", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part")
    )
    once = parts.groupBy("block", "part").applyInArrow(add, "block int, counts binary")
    twice = once.groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros(SLOTS, dtype=np.uint64)
    for block, counts in zip(twice["block"].to_pylist(), twice["counts"].to_pylist(), strict=True):
        out[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(counts, dtype=np.uint64)
    return out


def _levels(sketch: np.ndarray) -> np.ndarray:
    """0 for slots of ordinary load (chance included), then one more for each doubling."""
    ordinary = sketch.mean() + 6 * np.sqrt(sketch.mean()) + 4
    levels = np.zeros(len(sketch), dtype=np.int8)
    for at in range(0, len(sketch), 1 << 16):
        part = sketch[at : at + (1 << 16)]
        levels[at : at + (1 << 16)] = np.where(part > ordinary, np.frexp(part / ordinary)[1], 0)
    return levels


def prefix_postings(df: DataFrame, sketch: np.ndarray, buckets: int, k: int = K) -> DataFrame:
    """(bucket, postings): packed (shingle, id, size and place, parts) of the short lists of each text.

    A task passes over a set that it has already posted.
    """
    # Slots of lists that are dealt out in several parts; the sum of the sketch bounds their number.
    hot = np.flatnonzero(sketch >= PART_ROWS)
    parts = (1 + sketch[hot] // PART_ROWS).astype(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast((_levels(sketch), hot, parts))
    tb.release()  # the driver, too, keeps what it needed for the sketch

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, hot, hot_parts = shared.value
        posted: set[bytes] = set()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            all_rows = np.concatenate(held, axis=1)
            held.clear()
            part = all_rows[1].view(np.int64) % all_rows[3].view(np.int64)
            mixed = tb.mix(all_rows[0] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            bucket = (mixed % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            data = [np.ascontiguousarray(all_rows[:, order[edges[b] : edges[b + 1]]]).tobytes() for b in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "postings"]
            )

        for batch in batches:
            for piece in tb.slices(batch, "text", PIECE_BYTES):
                hashes, at = shingle_sets(piece.column("text"))
                ids = piece.column("id").to_numpy()
                n = np.diff(at)
                marks = np.column_stack([_sums(hashes, at), _sums(tb.mix(hashes), at)])
                fresh = np.zeros(len(n), dtype=bool)
                for i in range(len(n)):
                    mark = marks[i].tobytes()  # a tuple of two numbers takes three times the memory
                    if n[i] and mark not in posted:
                        fresh[i] = True
                        posted.add(mark)
                if len(posted) > POSTED_SETS:
                    posted.clear()
                slot = _slot(hashes)
                owner = np.repeat(np.arange(len(n)), n)
                level = levels[slot].astype(np.int64)
                # Hashes are in order inside a text; move the long lists behind the short ones.
                order = np.argsort(owner * 64 + level, kind="stable")
                rank = np.arange(len(owner)) - at[owner]
                least = -(-PERCENT * n // 100)
                use = (rank < (n - least + k)[owner]) & fresh[owner]
                chosen = order[use]
                of = owner[use]
                place = (n[of] + (rank[use] << 32)).astype(np.uint64)
                parts = np.ones(len(chosen), dtype=np.uint64)
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, slot[chosen]), len(hot) - 1)
                    parts = np.where(hot[near] == slot[chosen], hot_parts[near], parts)
                held.append(np.stack([hashes[chosen], ids[of].astype(np.int64).view(np.uint64), place, parts]))
                if sum(h.shape[1] for h in held) >= POSTINGS_HELD:
                    yield flush()
        if held:
            yield flush()

    return df.mapInArrow(lambda b: tb.tidy(rows(b)), "bucket int, postings binary")


_BAND = float(np.log(100 / PERCENT))


def shared_lists(postings: DataFrame, partitions: int) -> DataFrame:
    """(h, id, n, pos, parts, band, pivot) of all lists with more than one text; pivot is the first text
    of the same list (part) and band of sizes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A list part lies in one bucket. Buckets are sorted one after another, so the copies made are of one.
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, p in zip(batch.column("bucket").to_pylist(), batch.column("postings"), strict=True):
                held.setdefault(bucket, []).append(np.frombuffer(p.as_py(), dtype=np.uint64).reshape(4, -1))
        while held:
            yield from lists_of(held.popitem()[1])

    def lists_of(blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, ids, n, parts = np.concatenate(blocks, axis=1)
        blocks.clear()
        ids, n, parts = ids.view(np.int64), n.astype(np.int64), parts.astype(np.int64)
        pos, n = n >> 32, n & 0xFFFFFFFF
        band = (np.log(n) / _BAND).astype(np.int64)
        part = ids % parts
        order = np.lexsort((ids, band, part, h))
        h, ids, n, pos, parts, band, part = (x[order] for x in (h, ids, n, pos, parts, band, part))
        same = (h[1:] == h[:-1]) & (ids[1:] == ids[:-1]) & (n[1:] == n[:-1])
        keep = np.append(True, ~same)
        h, ids, n, pos, parts, band, part = (x[keep] for x in (h, ids, n, pos, parts, band, part))
        alone = np.append(True, h[1:] != h[:-1])
        several = ~(alone & np.append(alone[1:], True)) | (parts > 1)
        start = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (band[1:] != band[:-1]))
        pivot = ids[np.flatnonzero(start)[np.cumsum(start) - 1]]
        where = np.flatnonzero(several)
        for lo in range(0, len(where), 1 << 16):
            w = where[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[w]) for x in (h.view(np.int64), ids, n, pos, parts, band, pivot)],
                names=["h", "id", "n", "pos", "parts", "band", "pivot"],
            )

    dealt = postings.repartition(partitions, "bucket")
    return dealt.mapInArrow(lambda b: tb.tidy(rows(b)), "h long, id long, n long, pos long, parts long, band long, pivot long")


def heap_merge(lists: list[np.ndarray], threshold: int) -> dict[int, int]:
    """Members of at least ``threshold`` of the sorted lists, with their counts."""
    counts: dict[int, int] = {}
    current, times = -1, 0
    for member in heapq.merge(*(x.tolist() for x in lists)):
        if member == current:
            times += 1
            continue
        if times >= threshold:
            counts[current] = times
        current, times = member, 1
    if times >= threshold:
        counts[current] = times
    return counts


def divide_skip(query: np.ndarray, others: list[np.ndarray], k: int = K) -> list[int]:
    """Numbers of the sets that share enough shingles with the query (all are sorted)."""
    if not others or not len(query):
        return []
    sizes = np.array([len(o) for o in others])
    need = required(np.int64(len(query)), sizes)
    whole = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), sizes)
    at = np.minimum(np.searchsorted(query, whole), len(query) - 1)
    inside = query[at] == whole
    term, owner = at[inside], owner[inside]
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(query) + 1))
    lists = [owner[order[begin[i] : begin[i + 1]]] for i in np.flatnonzero(np.diff(begin))]
    if not lists:
        return []
    # The longest lists are set aside; a match keeps at least ``least`` in the rest.
    aside = min(max(int(need.min()) - k, 0), len(lists))
    least = max(int(need.min()) - aside, 1)
    lists.sort(key=len)
    found = heap_merge(lists[: len(lists) - aside], least)
    long_lists = lists[len(lists) - aside :]
    out = []
    for other, count in found.items():
        missing = int(need[other]) - count
        for i, members in enumerate(long_lists):
            if missing <= 0 or missing > len(long_lists) - i:
                break
            place = int(np.searchsorted(members, other))
            missing -= int(place < len(members) and members[place] == other)
        if missing <= 0:
            out.append(other)
    return out


def verified(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    pairs = stage(pairs.select("a", "b").distinct(), "candidates")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    # A checked number of ids is broadcast; otherwise the texts are joined by a shuffle.
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    texts = df.join(wanted, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.slices(batch, "text", PIECE_BYTES):
                hashes, at = shingle_sets(piece.column("text"))
                data = [hashes[at[i] : at[i + 1]].tobytes() for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(data, pa.binary())], names=["id", "shingles"]
                )

    sets_of = stage(texts.select("id", "text").mapInArrow(lambda b: tb.tidy(sets(b)), "id long, shingles binary"), "candidate-sets")
    width = sets_of.select(F.col("id").alias("b"), F.octet_length("shingles").alias("bytes"))
    groups = pairs.join(width, "b").groupBy("a").agg(F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("bytes") / GROUP_BYTES), F.lit(1)).cast("int")
    groups = stage(groups.select("a", parts.alias("parts")), "groups")
    others = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    others = others.join(sets_of.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")
    queries = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = queries.join(sets_of.withColumnRenamed("id", "a"), "a").select(
        "a", "part", F.lit(None).cast("long").alias("b"), "shingles"
    )

    def search(group: pa.Table) -> pa.Table:
        asked, names, sets = [], [], []
        for b, s in zip(group["b"].to_pylist(), group["shingles"], strict=True):
            own = np.frombuffer(s.as_py(), dtype=np.uint64)
            if b is None:
                asked.append(own)
            else:
                names.append(b)
                sets.append(own)
        found = sorted({names[i] for q in asked for i in divide_skip(q, sets)})
        asker = pa.array([group["a"][0].as_py()] * len(found), pa.int64())
        return pa.table({"a": asker, "b": pa.array(found, pa.int64())})

    both = queries.unionByName(others)
    return stage(both.groupBy("a", "part").applyInArrow(search, "a long, b long"), "links")


def _fits(n: str, m: str) -> str:
    """SQL condition: sizes that can reach the similarity."""
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): one row per row of ``df``."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stage(signatures(rows), "signatures")
    sizes = signed.filter("block IS NULL").select("id", "n", "s1", "s2")
    named = rows.filter("id IS NOT NULL")

    # Classes of equal sets.
    full = sizes.filter("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b < last")
    equal = full.join(classes.drop("last"), ["n", "s1", "s2"]).select(F.col("id").alias("a"), "b").filter("a <> b")
    equal = stage(equal, "equal-sets")

    postings = prefix_postings(named, sketch_of(signed), buckets=4 * partitions)
    lists = stage(shared_lists(postings, partitions), "shared-lists")

    # Round 1: each text with the first of its list and band; firsts of the parts of one list.
    stars = lists.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"), "n")
    pivots = lists.filter("parts > 1").select("h", "band", "pivot").distinct()
    heads = pivots.groupBy("h", "band").agg(F.min("pivot").alias("a"))
    of_parts = pivots.join(heads, ["h", "band"]).filter("a <> pivot")
    stars = stars.unionByName(of_parts.select("a", F.col("pivot").alias("b"), F.lit(1 << 31).alias("n")))
    counted = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.min("n").alias("n"))
    likely = counted.filter(f"lists >= least({K}, ceil({2 * PERCENT} * n / {100 + PERCENT}))")
    tested = stage(_unequal(likely.select("a", "b"), equal), "tested")
    first = verified(named, tested)
    reached = components(first.unionByName(equal))

    # Round 2: pairs from different components, where a list still has several.
    of = reached.select(F.col("node").alias("id"), "component")
    placed = lists.join(of, "id", "left").select(
        "h", "id", "n", "pos", F.coalesce("component", "id").alias("component")
    )
    placed = stage(placed, "placed-lists")
    held = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("h").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")
    )
    still = stage(placed.join(main.filter("kinds > 1"), "h"), "open-lists")
    rest = still.filter("component <> main").selectExpr("h", "id AS x", "n AS nx", "pos AS px", "component AS cx")
    every = still.selectExpr(
        "h", "id AS y", "n AS ny", "pos AS py", "component AS cy", "component <> main AS other"
    )
    need = f"ceil({PERCENT} * (nx + ny) / {100 + PERCENT})"
    near = f"least(nx - px, ny - py) > {need} - {K}"
    met = rest.join(every, "h").filter(f"cx <> cy AND (NOT other OR x < y) AND {_fits('nx', 'ny')} AND {near}")
    # The k first shared lists, or all that such small sets need.
    enough = f"lists >= least({K}, {need})"
    pairs = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.count(F.lit(1)).alias("lists"), F.min("nx").alias("nx"), F.min("ny").alias("ny")
    ).filter(enough)
    second = verified(named, pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"))
    final = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    labels = final.select(F.col("node").alias("id"), F.col("component").alias("found"))
    return sizes.join(labels, "id", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("found", "id").alias("component_id"),
    )


def _unequal(pairs: DataFrame, equal: DataFrame) -> DataFrame:
    """Pairs that are not already known as members of one class."""
    of = equal.select(F.col("a").alias("id"), F.col("b").alias("rep"))
    left = pairs.join(of.withColumnsRenamed({"id": "a", "rep": "ra"}), "a", "left")
    both = left.join(of.withColumnsRenamed({"id": "b", "rep": "rb"}), "b", "left")
    a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
