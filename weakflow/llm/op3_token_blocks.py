"""Token ids in patched frame-of-reference blocks.

A part file holds the ids of consecutive texts in blocks of ``BLOCK`` values. A block keeps its
minimum, and the differences to it packed at the width that suffices for ``PERCENTILE`` percent
of them; larger ones are patched from an exception list. The head of the part indexes the
start of every block, so that one block can be read alone (``read_block``). Integers are
little-endian:

    "PFR1"  values u32  blocks u32  start of each block u32 * (blocks + 1)
    block:  minimum u32  width u8  0 u8  exceptions u16  packed bits
            places of the exceptions u16 *  their differences u32 *

``write_parts`` sorts the texts by id with a range partitioning (ties by the hash of the text),
encodes them, and writes part files of about ``PART_TOKENS`` ids as rows of a Parquet table in
the shared folder, each with the ids and token counts of its texts (the counts are packed the
same way). ``read_documents`` decodes the parts again.

The tokenizer sees each distinct piece of text once per worker: a text is cut at ASCII white
space, which the vocabulary drops, and before trailing punctuation that follows an ASCII
letter; neither cut can change the ids. Pieces are remembered by a 64-bit hash.

A NULL text is an empty one: its only id is the end id. NULL document ids come first. Repeated
ids keep all their rows. An empty table has no parts.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weakflow.llm import textbytes as tb
from weakflow.sources.staging import new_path

BLOCK = 256
PERCENTILE = 90
PART_TOKENS = 1 << 20
END_ID = 2
CACHE_PIECES = 2_000_000  # pieces that a worker remembers before it starts afresh
SEGMENTS_PER_FILE = 8
_MAGIC = b"PFR1"
_ROWS = 512  # blocks packed at once


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value."""
    return np.frexp(x.astype(np.float64))[1]


def pack(values: np.ndarray) -> bytes:
    """A part file of unsigned 32-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint32)
    grid[:n] = values
    if n:
        grid[n:] = values[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=0xFFFFFFFF)
    diff = grid - low[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    width = _bits(np.partition(diff, rank, axis=1)[:, rank]) if blocks else np.zeros(0, dtype=np.int64)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(axis=1)
    size = 8 + width * (BLOCK // 8) + exceptions * 6
    start = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(size, out=start[1:])
    body = np.zeros(start[-1], dtype=np.uint8)
    for kind, at, values8 in (("<u4", 0, low), ("u1", 4, width), ("<u2", 6, exceptions)):
        raw = np.ascontiguousarray(values8.astype(kind)).view(np.uint8).reshape(blocks, int(kind[-1]))
        body[start[:-1, None] + at + np.arange(raw.shape[1])] = raw
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for some in np.array_split(rows, -(-len(rows) // _ROWS)):
            bits = (diff[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(bits.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            body[start[some, None] + 8 + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = start[row] + 8 + width[row] * (BLOCK // 8)
    for kind, at, values8 in (
        ("<u2", tail + 2 * nth, place),
        ("<u4", tail + 2 * exceptions[row] + 4 * nth, diff[row, place]),
    ):
        raw = np.ascontiguousarray(values8.astype(kind)).view(np.uint8).reshape(len(row), int(kind[-1]))
        body[at[:, None] + np.arange(raw.shape[1])] = raw
    head = _MAGIC + struct.pack("<II", n, blocks)
    return head + start.astype("<u4").tobytes() + body.tobytes()


def _opened(part: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    if part[:4] != _MAGIC:
        raise ValueError("not a part file")
    n, blocks = struct.unpack_from("<II", part, 4)
    start = np.frombuffer(part, dtype="<u4", count=blocks + 1, offset=12).astype(np.int64)
    return n, start, np.frombuffer(part, dtype=np.uint8, offset=12 + 4 * (blocks + 1))


def _field(body: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(body[at[:, None] + np.arange(width)])
    return raw.view(kind).reshape(-1).astype(np.int64)


def _blocks(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at ``start``, one block per row."""
    low, width, exceptions = (_field(body, start + a, k) for a, k in ((0, "<u4"), (4, "u1"), (6, "<u2")))
    out = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        for some in np.array_split(rows, -(-len(rows) // _ROWS)):
            packed = body[start[some, None] + 8 + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            for b in range(w):
                out[some] |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    row = np.repeat(np.arange(len(start)), exceptions)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = start[row] + 8 + width[row] * (BLOCK // 8)
    places = _field(body, tail + 2 * nth, "<u2")
    out[row, places] = _field(body, tail + 2 * exceptions[row] + 4 * nth, "<u4")
    return out + low[:, None].astype(np.uint32)


def unpack(part: bytes) -> np.ndarray:
    """All values of a part file."""
    n, start, body = _opened(part)
    return _blocks(body, start[:-1]).ravel()[:n]


def read_block(part: bytes, block: int) -> np.ndarray:
    """The values of one block, found by the index of block starts."""
    n, start, body = _opened(part)
    return _blocks(body, start[block : block + 1]).ravel()[: n - block * BLOCK]


class PieceEncoder:
    """Encodes columns of text; keeps the ids of the pieces that it has met."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint16)

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end, pieces per text)."""
        words = tb.find_words(column, tb.NOT_SPACE, lower=False)
        data, start, end = words.data, words.start, words.end
        if not len(start):
            return data, start, end, words.counts()

        def holds(flags: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(flags, dtype=np.int32))
            return sums[end] > sums[start]

        mark = np.append((data[:-1] == ord("<")) & (data[1:] == ord("|")), False)
        special = holds(mark)
        same = special | holds(data >= 128)
        lowered = tb._LOWER[data]
        for i in np.flatnonzero(same):
            lowered[start[i] : end[i]] = data[start[i] : end[i]]
        punctuation = (data < 128) & ~tb.ALPHANUMERIC[data]
        last = np.maximum.accumulate(np.where(punctuation, -1, np.arange(len(data))))
        cut = last[end - 1] + 1
        letter = (lowered >= ord("a")) & (lowered <= ord("z")) | (data >= ord("A")) & (data <= ord("Z"))
        cuts = ~special & (cut > start) & (cut < end) & letter[np.maximum(cut - 1, 0)]
        many = 1 + cuts
        ends_at = np.cumsum(many)
        starts = np.repeat(start, many)
        ends = np.repeat(end, many)
        first = (ends_at - many)[cuts]
        ends[first] = cut[cuts]
        starts[first + 1] = cut[cuts]
        per_text = np.diff(np.append(0, ends_at)[words.first])
        return lowered, starts, ends, per_text

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        sizes = np.empty(len(texts), dtype=np.int64)
        found = [self.ids]
        for lo in range(0, len(texts), 4096):
            some = texts[lo : lo + 4096]
            begin = np.append(0, np.cumsum([len(t) + 1 for t in some]))
            coded = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            at = np.array([o[0] for o in coded.offsets], dtype=np.int64)
            owner = np.searchsorted(begin, at, "right") - 1
            sizes[lo : lo + 4096] = np.bincount(owner, minlength=len(some))
            found.append(np.array(coded.ids, dtype=np.uint16))
        at = len(self.ids) + np.append(0, np.cumsum(sizes)[:-1])
        self.ids = np.concatenate(found)
        keys, at, sizes = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, sizes)))
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], sizes[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        data, start, end, per_text = self._pieces(column)
        keys, where, back = np.unique(tb.hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self.clear()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            spans = tb.spans_as_binary(data, start[where[new]], end[where[new]])
            self._learn(keys[new], spans.cast(pa.large_string()).to_pylist())
        at = np.searchsorted(self.keys, keys)
        first, size = self.at[at][back], self.size[at][back]
        out = np.append(0, np.cumsum(size))
        places = np.arange(out[-1]) + np.repeat(first - out[:-1], size)
        texts = np.append(0, np.cumsum(per_text))
        return self.ids[places], np.diff(out[texts])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_parts(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> str:
    """Write all texts in ascending key order; the folder of the parts is returned."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            names = pa.concat_arrays([h[0] for h in held])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([partition], pa.int32()),
                    pa.array([n], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([pack(sizes)], pa.binary()),
                    pa.array([pack(ids)], pa.binary()),
                ],
                names=["shard", "part", "tokens", "ids", "counts", "data"],
            )

        for batch in batches:
            for piece in tb.slices(batch, "text"):
                ids, sizes = encoder(tokenizer_path).encode(piece.column("text"))
                # The end id after each text.
                whole = np.insert(ids, np.cumsum(sizes), end_id)
                held.append((piece.column("id"), whole, sizes + 1))
                if sum(len(h[1]) for h in held) >= PART_TOKENS:
                    yield flush()
                    n += 1
        if held:
            yield flush()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered = ordered.select("id", "text")
    schema = f"shard int, part int, tokens long, ids array<{kind}>, counts binary, data binary"
    path = new_path(df.sparkSession, "token-parts")
    ordered.mapInArrow(parts, schema).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).parquet(path)
    return path


def read_documents(spark, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the stored parts."""
    parts = spark.read.parquet(path)
    sizes = parts.select("shard", "part", "tokens")
    per_shard = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    begins = begins.join(per_shard, "shard").select(
        "shard", "part", (F.col("before") + F.col("inside")).alias("begin")
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                names = row.column("ids").flatten()
                sizes = unpack(row.column("counts")[0].as_py())
                ids = np.ascontiguousarray(unpack(row.column("data")[0].as_py()), dtype="<u4")
                ends = np.cumsum(sizes, dtype=np.int64)
                crc = [zlib.crc32(ids[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pc.cast(pa.repeat(row.column("shard")[0].as_py(), n), pa.int32()),
                        pc.cast(pa.repeat(row.column("part")[0].as_py(), n), pa.int32()),
                        pa.array(ends - sizes),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["id", "shard", "part", "inside", "n_tokens", "ids_crc32"],
                )

    kind = parts.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {kind}, shard int, part int, inside long, n_tokens long, ids_crc32 long"
    decoded = parts.mapInArrow(documents, schema)
    return decoded.join(begins, ["shard", "part"]).select(
        F.col("id").alias(key), (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
