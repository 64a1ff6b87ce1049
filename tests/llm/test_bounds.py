"""What a task of the Jaccard join holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from weakflow.llm import op9_jaccard


class Task:
    """Stands for a table of which one task runs here."""

    def __init__(self, *columns):
        self.columns = columns

    def repartition(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function(iter(self.columns))


def test_sketch_leaves_a_task_in_small_batches():
    texts = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a b c d e f", None]})
    batches = list(op9_jaccard.signatures(Task(texts)))
    assert max(b.nbytes for b in batches) <= 2 << 20
    blocks = [(k, c) for b in batches for k, c in zip(b["block"].to_pylist(), b["counts"].to_pylist()) if k is not None]
    assert [k for k, _ in blocks] == list(range(op9_jaccard.SLOTS // op9_jaccard._BLOCK))
    assert np.frombuffer(b"".join(c for _, c in blocks), dtype=np.uint32).sum() == 2
    assert sum(b["n"].drop_null().to_pylist().count(2) for b in batches) == 1


def test_lists_are_sorted_bucket_by_bucket():
    rng = np.random.default_rng(3)
    buckets, rows = 8, 40_000
    batches, want = [], 0
    for bucket in range(buckets):
        h = rng.integers(0, rows // 2, rows, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        ids = np.arange(rows, dtype=np.uint64)
        place, parts = np.full(rows, 100, dtype=np.uint64), np.ones(rows, dtype=np.uint64)
        held = np.bincount((h // np.uint64(buckets)).astype(np.int64))
        want += held[held > 1].sum()
        data = np.stack([h, ids, place, parts])
        for half in (data[:, : rows // 2], data[:, rows // 2 :]):
            batches.append(pa.RecordBatch.from_pydict({"bucket": [bucket], "postings": [np.ascontiguousarray(half).tobytes()]}))
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in op9_jaccard.shared_lists(Task(*batches), 1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == want
    assert peak < 4 * sum(b.nbytes for b in batches)
