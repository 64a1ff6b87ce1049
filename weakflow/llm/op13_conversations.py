"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

A legal conversation has role initials ``(s?(ua)+)?``. Keeping a row costs 0, calling it user or
assistant 1, deleting it 2 (the only choice for blank and repeated rows), an empty row put in 5, and a
truncated row that stays 5 more. The best edits of a conversation are a shortest path through four states
(nothing yet, after s, after u, after a), found backwards: a vector holds, per state, the cost from here
to the end.

Rank-convergence parallel Viterbi: all rows lie in one global order, cut into chunks of 4,096, and each
chunk is a task's group, whatever conversation its rows belong to. A chunk cannot know the vector at its
right edge, so it starts from a speculative one (that of an end). Where the conversation goes on, a fix-up
pass starts again from what the next chunk found, and stops at the row from which the new vector differs
from the speculative one by a constant: from there on the old run is right but for that constant. Passes
repeat until no vector changes. Constants add up to the cost. The audit is traced forwards, least letter
first among the edits that keep to the stitched backward costs; each chunk says which state it leaves for
each state it is entered in, and these maps are joined by pointer doubling. So one conversation with a
third of all rows takes as many tasks as its rows need; only its SHA-256, which is sequential, streams
through one task, line by line.

Texts move once, for that hash; everything else works on rows of a digest, an initial and flags. Chunk
borders, vectors and maps are tables in the shared folder, so a lost executor repeats tasks, not passes.

Cases: a NULL conv_id is a conversation of its own; a NULL turn sorts first and takes no part in gaps;
NULL roles and texts, and NULLs in the key of ``damage``, read as one space. Rows of the same turn go by
a digest of role and text; equal rows are interchangeable. Repeated rows are duplicates. Empty texts are
blank. Roles with other initials can only be renamed or deleted. Long texts are read whole. A conversation
without rows after the damage has zeros, an empty audit and the hash of nothing. Other columns, whatever
their names, are not read. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from weakflow.sources.staging import stage

SPACE = " \t\n\x0b\x0c\r"
CHUNK_BITS = 12  # a chunk holds 2 ** 12 rows
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5  # costs; CUT is added for a truncated row that stays

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The costs from a state to an end.
END = (0, 2 * INSERT, INSERT, 0)
_NEXT = (2, 2, 3, 2)  # the state after one more user or assistant row
_ROLES = {2: "user", 3: "assistant"}
_KEPT = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}

Vector = tuple[int, int, int, int]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 chooses."""
    fate = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % 20
    read = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), fate.alias("_fate"))
    role = F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role"))
    text = (
        F.when(F.col("_fate") == 1, F.lit(""))
        .when(F.col("_fate") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    hit = read.filter("_fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy"))
    return hit.drop("_copy")


def _mark() -> Column:
    """A digest that stands for role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _bare() -> Column:
    return F.rtrim(F.col("text"), F.lit(SPACE))


def ordered(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows without their texts, with their place in the global order (conversation, turn, digest) and
    their chunk. Equal rows are told apart by where they were read, so that they spread over tasks too."""
    bare = _bare()
    flags = rows.select(
        "conv_id",
        "turn",
        _mark().alias("mark"),
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("_read"),
    )
    keys = ["conv_id", "turn", "mark", "_read"]
    placed = flags.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    placed = stage(placed.withColumn("place", F.monotonically_increasing_id()), "places")
    # A place is the number of a partition and, in its lower 33 bits, a number inside it.
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    chunks = placed.groupBy(part.alias("_part")).agg((F.shiftright(F.max(inside), chunk_bits) + 1).alias("_chunks"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("_part", F.coalesce(F.sum("_chunks").over(earlier), F.lit(0)).alias("_before"))
    dealt = placed.withColumn("_part", part).join(before, "_part")
    dealt = dealt.withColumn("chunk", F.col("_before") + F.shiftright(inside, chunk_bits)).drop("_part", "_before")
    firsts = dealt.groupBy("conv_id", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    told = dealt.join(firsts, "place", "left").withColumn("repeated", F.col("_first").isNull() & ~F.col("blank"))
    return stage(told.drop("_first", "mark").join(placed.select("place", "mark"), "place"), "rows")


def _closed(v0: int, v1: int, v2: int, v3: int) -> Vector:
    """The vector once rows may be put in here."""
    u, a = min(v2, INSERT + v3), min(v3, INSERT + v2)
    return min(v0, INSERT + u), min(v1, INSERT + u), u, a


def _edits(kind: str, after: Vector) -> list[list[tuple[int, str, int]]]:
    """Per state the edits of a row: (cost to the end, letter, next state). ``kind`` is the initial,
    '-' for another one or 'x' for a row that must go; in upper case, or '_', for a truncated row."""
    edits = [[(DELETE + after[s], "D", s)] for s in range(4)]
    low = kind.lower()
    if low == "x":
        return edits
    extra = CUT if kind != low or kind == "_" else 0
    for s, to in _KEPT.get(low, ()):
        edits[s].append((extra + after[to], "K", to))
    for s in range(4):
        to = _NEXT[s]
        edits[s].append((RENAME + extra + after[to], "R", to))
    return edits


def _before(kind: str, after: Vector) -> Vector:
    return _closed(*[min(e[0] for e in of_state) for of_state in _edits(kind, after)])


def _normal(v: Vector) -> tuple[Vector, int]:
    low = min(v)
    return (v[0] - low, v[1] - low, v[2] - low, v[3] - low), low


def backward(kinds: str, end: Vector) -> list[Vector]:
    """The vector before each row and, last, after all."""
    vectors = [end]
    for kind in reversed(kinds):
        vectors.append(_before(kind, vectors[-1]))
    return vectors[::-1]


def fix_up(kinds: str, old: Vector, new: Vector, begin: Vector, gain: int) -> tuple[Vector, int, int]:
    """(begin, gain, rows) of a run from ``new`` instead of ``old``, which had given ``begin`` and
    ``gain``; stops at the row from which both differ by a constant."""
    done = 0
    for kind in reversed(kinds):
        shift = new[0] - old[0]
        if all(n - o == shift for n, o in zip(new, old)):
            return begin, gain + shift, done
        old, new = _before(kind, old), _before(kind, new)
        done += 1
    found, low = _normal(new)
    return found, low, done


def trace(kinds: str, vectors: list[Vector], state: int, ends: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The least edits from ``state``: (letter, row, state after it), and the last state. Rows are put
    in after the last one only where the conversation ends."""
    path = []
    for i, kind in enumerate(kinds):
        edits = _edits(kind, vectors[i + 1])
        while True:
            cost = vectors[i][state]
            found = min((e[1:] for e in edits[state] if e[0] == cost), default=("~", 0))
            if found[0] != "D" and INSERT + vectors[i][_NEXT[state]] == cost:
                state = _NEXT[state]
                path.append(("I", -1, state))
                continue
            break
        letter, state = found
        path.append((letter, i, state))
    while ends and vectors[-1][state] > 0:
        state = _NEXT[state]
        path.append(("I", -1, state))
    return path, state


def _kinds(rows: pa.Table) -> str:
    kinds = []
    for initial, blank, cut, repeated in zip(*(rows.column(c).to_pylist() for c in ("initial", "blank", "cut", "repeated"))):
        kind = "x" if blank or repeated else initial if initial in ("s", "u", "a") else "-"
        # '-' has no upper case, so a truncated row of another role is '_'.
        kinds.append(kind if kind == "x" or not cut else "_" if kind == "-" else kind.upper())
    return "".join(kinds)


def _segments(rows: pa.Table) -> list[pa.Table]:
    """The rows of a chunk, cut where the conversation changes."""
    rows = rows.sort_by("place")
    ids = rows.column("conv_id").to_pylist()
    cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    return [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _speculate(rows: pa.Table) -> pa.Table:
    parts = _segments(rows)
    found = []
    for k, part in enumerate(parts):
        initials = [x if x in ("s", "u", "a") else "-" for x in part.column("initial").to_pylist()]
        blank, cut, repeated = (part.column(c).to_pylist() for c in ("blank", "cut", "repeated"))
        begin, gain = _normal(backward(_kinds(part), END)[0])
        found.append(
            {
                "conv_id": part.column("conv_id")[0].as_py(),
                "sid": part.column("place")[0].as_py(),
                "last": part.column("place")[-1].as_py(),
                "chunk": part.column("chunk")[0].as_py(),
                "at_start": k == 0,
                "at_end": k == len(parts) - 1,
                "used": list(END),
                "begin": list(begin),
                "gain": gain,
                "head": initials[0],
                "tail": initials[-1],
                "blank": sum(blank),
                "duplicate": sum(repeated),
                "truncated": sum(c and not b and not r for c, b, r in zip(cut, blank, repeated)),
                "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
            }
        )
    return pa.Table.from_pylist(found, _arrow(rows.schema.field("conv_id").type, _SEGMENT))


_SEGMENT = {
    "sid": "long",
    "last": "long",
    "chunk": "long",
    "at_start": "boolean",
    "at_end": "boolean",
    "used": "array<int>",
    "begin": "array<int>",
    "gain": "long",
    "head": "string",
    "tail": "string",
    "blank": "long",
    "duplicate": "long",
    "truncated": "long",
    "illegal": "long",
}
_ITEM = {"sid": "long", "step": "int", "audit": "string", "mark": "binary", "role": "string"}
_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
}


def _arrow(conv: pa.DataType, columns: dict[str, str]) -> pa.Schema:
    return pa.schema([("conv_id", conv), *[(name, _ARROW[kind]) for name, kind in columns.items()]])


def _spark(rows: DataFrame, columns: dict[str, str]) -> StructType:
    fields = [StructField(name, _parse_datatype_string(kind)) for name, kind in columns.items()]
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *fields])


def _fix_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    one = {c: rows.column(c)[0].as_py() for c in ("sid", "used", "received", "begin", "gain")}
    begin, gain, _ = fix_up(_kinds(rows), tuple(one["used"]), tuple(one["received"]), tuple(one["begin"]), one["gain"])
    row = {"sid": one["sid"], "used": one["received"], "begin": list(begin), "gain": gain}
    return pa.Table.from_pylist([row], pa.schema([(c, _ARROW[_SEGMENT[c]]) for c in ("sid", "used", "begin", "gain")]))


def _within(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of some segments. A chunk has at most two that reach beyond it."""
    met = rows.drop("conv_id").join(segments, "chunk")
    return met.filter("place BETWEEN sid AND last")


def stitched(rows: DataFrame, segments: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, used, begin, gain) of the linked segments, once the fix-up passes change no vector."""
    ends = links.select("sid").unionByName(links.select(F.col("next").alias("sid"))).distinct()
    state = stage(segments.join(ends, "sid").select("sid", "used", "begin", "gain"), "vectors")
    spans = stage(segments.join(links, "sid").select("sid", "last", "chunk", "next"), "spans")
    while True:
        following = state.select(F.col("sid").alias("next"), F.col("begin").alias("received"))
        stale = spans.join(following, "next").join(state, "sid").filter("received <> used")
        stale = stage(stale, "stale")
        if stale.isEmpty():
            return state
        fixed = _within(rows, stale).groupBy("sid").applyInArrow(_fix_group, "sid long, used array<int>, begin array<int>, gain long")
        fixed = stage(fixed, "fixed")
        state = stage(state.join(fixed, "sid", "left_anti").unionByName(fixed), "vectors")


def _exits(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    kinds = _kinds(rows)
    vectors = backward(kinds, tuple(rows.column("used")[0].as_py()))
    row = {"sid": rows.column("sid")[0].as_py(), "exits": [trace(kinds, vectors, s, False)[1] for s in range(4)]}
    return pa.Table.from_pylist([row], pa.schema([("sid", pa.int64()), ("exits", pa.list_(pa.int32()))]))


def entries(rows: DataFrame, spans: DataFrame, state: DataFrame) -> DataFrame:
    """(sid, entry): the state in which the trace enters each linked segment but the first."""
    exits = _within(rows, spans.join(state.select("sid", "used"), "sid")).groupBy("sid").applyInArrow(_exits, "sid long, exits array<int>")
    hops = spans.join(exits, "sid").select(F.col("next").alias("sid"), F.col("sid").alias("back"), "exits")
    hops = stage(hops, "hops")
    while True:
        prior = hops.select(F.col("sid").alias("back"), F.col("back").alias("further"), F.col("exits").alias("earlier"))
        joined = hops.join(prior, "back", "left")
        composed = F.transform("earlier", lambda s: F.element_at("exits", s + 1))
        hops = stage(
            joined.select(
                "sid",
                F.coalesce("further", "back").alias("back"),
                F.when(F.col("further").isNull(), F.col("exits")).otherwise(composed).alias("exits"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "hops",
        )
        if hops.filter("moved").isEmpty():
            return hops.select("sid", F.element_at("exits", 1).alias("entry"))
        hops = hops.drop("moved")


def _trace_chunk(rows: pa.Table, known: pa.Table) -> pa.Table:
    of_sid = {k["sid"]: k for k in known.to_pylist()}
    found = []
    for part in _segments(rows):
        sid, conv = part.column("place")[0].as_py(), part.column("conv_id")[0].as_py()
        k = of_sid.get(sid, {"used": END, "entry": 0, "ends": True})
        kinds = _kinds(part)
        path, _ = trace(kinds, backward(kinds, tuple(k["used"])), k["entry"], k["ends"])
        found.append({"conv_id": conv, "sid": sid, "step": -1, "audit": "".join(p[0] for p in path)})
        marks = part.column("mark")
        for step, (letter, row, state) in enumerate(path):
            if letter != "D":
                mark = None if letter == "I" else marks[row].as_py()
                role = None if letter == "K" else _ROLES[state]
                found.append({"conv_id": conv, "sid": sid, "step": step, "mark": mark, "role": role})
    return pa.Table.from_pylist(found, _arrow(rows.schema.field("conv_id").type, _ITEM))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of lines that come sorted by conversation; one line is held at a time."""
    current, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done_ids, done = [], []
        lines = batch.column("line")
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            if digest is None or conv != current:
                if digest is not None:
                    done_ids.append(current)
                    done.append(digest.hexdigest())
                current, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(lines[i].as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(done_ids, kind), pa.array(done, pa.string())], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([current], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"]
        )


def repaired_lines(items: DataFrame, damaged: DataFrame) -> DataFrame:
    """(conv_id, sid, step, line): the rows that stay or are put in, partitioned by conversation.

    Rows that stay are the first with their digest, so an item and a text of the same digest meet."""
    kept = items.filter("step >= 0").select("conv_id", "sid", "step", "mark", "role", F.lit(None).cast("string").alias("text"))
    texts = damaged.filter(_bare() != "").select(
        "conv_id",
        F.lit(None).cast("long").alias("sid"),
        F.lit(None).cast("int").alias("step"),
        _mark().alias("mark"),
        "role",
        "text",
    )
    met = Window.partitionBy("conv_id", "mark").orderBy(F.col("text").isNotNull())
    item = F.first(F.struct("sid", "step", "role")).over(met.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = kept.unionByName(texts).repartition("conv_id")
    both = both.select("*", item.alias("item"), F.row_number().over(met).alias("n"))
    put_in = F.col("mark").isNull()
    both = both.filter(put_in | ((F.col("n") == 2) & F.col("item.sid").isNotNull()))
    line = F.when(put_in, F.concat("role", F.lit(":"))).otherwise(F.concat(F.coalesce("item.role", "role"), F.lit(":"), "text"))
    return both.select(
        "conv_id",
        F.when(put_in, F.col("sid")).otherwise(F.col("item.sid")).alias("sid"),
        F.when(put_in, F.col("step")).otherwise(F.col("item.step")).alias("step"),
        line.alias("line"),
    )


def repair(original: DataFrame, damaged: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per conversation of ``original`` with the faults of ``damaged`` and its cheapest repair."""
    rows = ordered(damaged, chunk_bits)
    segments = stage(rows.groupBy("chunk").applyInArrow(_speculate, _spark(rows, _SEGMENT)), "segments")
    leave = segments.filter("at_end").select("sid", "conv_id", "tail", (F.col("chunk") + 1).alias("_chunk"))
    enter = segments.filter("at_start").select(
        F.col("sid").alias("next"), F.col("conv_id").alias("_conv"), "head", F.col("chunk").alias("_chunk")
    )
    links = leave.join(enter, "_chunk").filter(F.col("conv_id").eqNullSafe(F.col("_conv")))
    links = stage(links.select("conv_id", "sid", "next", F.concat("tail", "head").alias("pair")), "links")

    state = stitched(rows, segments, links.select("sid", "next"))
    spans = segments.join(links.select("sid", "next"), "sid").select("sid", "last", "chunk", "next")
    entry = entries(rows, spans, state)
    chunk_of = segments.select("sid", "chunk")
    known = state.join(chunk_of, "sid").join(entry, "sid", "left").join(links.select("sid", "next"), "sid", "left")
    known = known.select("sid", "chunk", "used", F.coalesce("entry", F.lit(0)).alias("entry"), F.col("next").isNull().alias("ends"))
    traced = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_trace_chunk, _spark(rows, _ITEM))
    items = stage(traced, "edits")
    hashes = repaired_lines(items, damaged).sortWithinPartitions("conv_id", "sid", "step").select("conv_id", "line")
    hashed = hashes.mapInArrow(_hash_lines, _spark(rows, {"repaired_sha256": "string"}))

    final = segments.join(state.select("sid", F.col("begin").alias("_begin"), F.col("gain").alias("_gain")), "sid", "left")
    final = final.join(links.select(F.col("next").alias("sid"), F.lit(True).alias("_goes_on")), "sid", "left")
    first = F.when(F.col("_goes_on").isNull(), F.element_at(F.coalesce("_begin", "begin"), 1)).otherwise(0)
    counted = final.select(
        "conv_id", "blank", "duplicate", "truncated", "illegal", (F.coalesce("_gain", "gain") + first).cast("long").alias("cost")
    )
    borders = links.select("conv_id", (~F.col("pair").isin("su", "ua", "au")).cast("long").alias("illegal"))
    turns = rows.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = turns.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    audits = items.filter("step < 0").select("conv_id", F.struct("sid", "audit").alias("piece"))

    facts = original.select("conv_id").distinct()
    for table in (counted, borders, gaps, audits, hashed):
        facts = facts.unionByName(table, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["audit"])
    return facts.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers],
        F.array_join(pieces, "").alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
