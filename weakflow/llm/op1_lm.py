"""Log-bilinear language model trained with noise-contrastive estimation.

Tokens are words (lower-cased A-Z) and one end per text. The model predicts an output symbol:
the end, one of the ``HEAD`` most frequent words, or the class of any other word (its last
letter, and whether punctuation follows it). The probability of a word of a class is its
smoothed share of that class, so the probabilities of all words, with one unseen word per
class, add up to one:

    log p(w | h) = log softmax(Q (sum_j C_j R[h_j]) + b)[symbol(w)] + log((c + 1) / (N_s + V_s + 1))

where h_1 .. h_n are the symbols before w; the softmax is mixed with a small share of the
unigram distribution of the symbols.

Counting covers all training texts: words are counted inside each task, and the counts are
added up by a shuffle on a 64-bit hash of the word. All texts are then cut into words once more
and stored as symbols (a byte per token) with their sums of word shares; training and scoring
read only these. Training goes over every position of all training texts: each task trains a
copy of the parameters by AdaGrad on the NCE objective in numpy, with noise symbols from the
unigram distribution shared by a batch, and the copies are averaged by a Spark aggregation,
weighted by their tokens, once per round. Texts are dealt evenly to as many tasks as there are
cores, or a multiple of it. Each round reads every text equally often: once, and more often only if the whole
corpus has fewer than ``LEAST_POSITIONS`` tokens. Scoring is a matrix product per batch of
positions. The counts of the most frequent words (at most ``DICTIONARY_WORDS``) are sent to the
tasks; all rarer words are joined with the full table.

A NULL or empty text is one end. A NULL id counts as an empty one for the fold. Rows with the
same id stay separate rows. A very long text is scored whole; a task holds its symbols and works
on a batch of positions at a time. Further columns are not read. Without training texts all counts are zero and the model is
uniform over its symbols.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.llm import textbytes as tb
from weakflow.sources.staging import stage

FOLDS, HELD_OUT = 7, 2
HEAD = 189
CLASSES = 62
DIM, CONTEXT = 32, 5
NOISE, BATCH = 32, 2048
ROUNDS = 2
RATE = 0.08
SCORED = 1024  # positions scored by one matrix product
LEAST_POSITIONS = 2_000_000  # a smaller corpus is read several times in each round
MOST_EPOCHS = 64
TRAIN_TOKENS = 1 << 25  # tokens in a task at most, about; few long tasks, since their copies are averaged
SCORE_TOKENS = 1 << 22
FRONT = 1 << 20  # places of the table that finds most words without a search
UNIGRAM_SHARE = 0.05
DICTIONARY_WORDS = 1 << 19
END_HASH = np.uint64(0)  # no word is expected to hash to zero
END = 0  # output symbols: the end, head words, classes; START only stands in contexts
MARKS_STEPPED = 4  # trailing marks of a word that are passed one by one
_MARK = ~tb.ALPHANUMERIC & (np.arange(256) < 128)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_classes(words: tb.Words) -> np.ndarray:
    """The class of each word: its last byte before trailing punctuation, and if there is any."""
    data, start, end = words.data, words.start, words.end
    if not len(start):
        return np.empty(0, dtype=np.int64)
    last = end - 1
    marked = np.flatnonzero(_MARK[data[last]])
    for _ in range(MARKS_STEPPED):
        last[marked] -= 1
        marked = marked[last[marked] >= start[marked]]
        marked = marked[_MARK[data[last[marked]]]]
    if len(marked):  # words that end in many marks
        last[marked] = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[end[marked] - 1]
    plain = last >= start
    byte = data[np.where(plain, last, start)].astype(np.int64)
    kind = np.where((byte >= 97) & (byte <= 122), byte - 97, np.where(byte >= 128, 26 + byte % 4, 30))
    kind = np.where(plain, kind, 30)
    return kind * 2 + (last < end - 1)


@dataclass
class Vocabulary:
    """Counts known to every task. ``keys`` are sorted hashes with their counts and symbols."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    unigram: np.ndarray  # training count of each symbol
    class_base: np.ndarray  # log10(N_s + V_s + 1) of each class
    end_count: int
    tokens: int
    distinct: int
    front: np.ndarray | None = None

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place in ``keys`` where each hash stands, if it does. A table by low bits holds the
        most frequent word of each place; only words not found there are searched for."""
        if self.front is None:
            self.front = np.zeros(FRONT, dtype=np.int32)
            rising = np.argsort(self.counts, kind="stable")
            self.front[(self.keys[rising] & np.uint64(FRONT - 1)).astype(np.int64)] = rising
        at = self.front[(hashes & np.uint64(FRONT - 1)).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != hashes)
        at[missed] = np.minimum(np.searchsorted(self.keys, hashes[missed]), len(self.keys) - 1)
        return at

    def look_up(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count, in the dictionary?) of each word."""
        if not len(self.keys):
            return 1 + HEAD + classes, np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = self.places(hashes)
        found = self.keys[at] == hashes
        symbol = np.where(found & (self.symbols[at] > 0), self.symbols[at], 1 + HEAD + classes)
        return symbol, np.where(found, self.counts[at], 0), found


def count_words(df: DataFrame) -> DataFrame:
    """(h, class, n) of all words of ``df``, counted in each task before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def counted(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(h)
            h = h[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, dtype=np.int64)
            return h[start], c[order[start]], np.add.reduceat(n[order], start) if len(h) else n

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def out() -> pa.RecordBatch:
            h, c, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["h", "class", "n"]
            )

        for batch in batches:
            for piece in tb.slices(batch, "text"):
                words = tb.find_words(piece.column("text"), tb.NOT_SPACE)
                h = words.hashes()
                held.append(counted(h, word_classes(words).astype(np.int32), np.ones(len(h), dtype=np.int64)))
                if len(held) >= 16:
                    held[:] = [merged()]
                    if len(held[0][0]) > 2_000_000:
                        yield out()
        if held:
            yield out()

    counted = df.mapInArrow(rows, "h long, class int, n long")
    return counted.groupBy("h").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """What every task needs to know of the stored counts; ``texts`` is the number of ends."""
    n_of = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    least, words = 1 << 62, 0
    for row in n_of.toLocalIterator():  # stops once the dictionary is full
        if words + row["words"] > DICTIONARY_WORDS:
            break
        least, words = row["n"], words + row["words"]
    frequent = counts.filter(F.col("n") >= least).toArrow()
    h, n = frequent["h"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    top = np.lexsort((h, -n))[:HEAD]
    symbols = np.zeros(len(h), dtype=np.int64)
    symbols[top] = 1 + np.arange(len(top))
    order = np.argsort(h)
    classes = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        mass[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    head_class = frequent["class"].to_numpy()[top]
    tokens, distinct = int(mass.sum()) + texts, int(kinds.sum()) + (texts > 0)
    np.subtract.at(mass, head_class, n[top])
    np.subtract.at(kinds, head_class, 1)
    unigram = np.zeros(1 + HEAD + CLASSES)
    unigram[END], unigram[1 : 1 + len(top)] = texts, n[top]
    unigram[1 + HEAD :] = mass
    return Vocabulary(
        h[order], n[order], symbols[order], unigram, np.log10(mass + kinds + 1), texts, tokens, distinct
    )


class Model:
    """Parameters: R (contexts), C (one matrix per place), Q and b (outputs)."""

    def __init__(self, unigram: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        v = len(unigram)
        self.noise = (unigram + 1.0) / (unigram.sum() + v)
        self.R = rng.normal(0, 0.1, (v + 1, DIM)).astype(np.float32)
        self.C = np.stack([np.eye(DIM) / CONTEXT] * CONTEXT).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (v, DIM)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.R, self.C, self.Q, self.b]

    def flat(self) -> np.ndarray:
        """All parameters as rows of DIM numbers."""
        whole = np.concatenate([a.ravel() for a in self.arrays()])
        return np.append(whole, np.zeros(-len(whole) % DIM, dtype=np.float32)).reshape(-1, DIM)

    def load(self, rows: np.ndarray) -> None:
        at, whole = 0, rows.ravel().astype(np.float32)
        for a in self.arrays():
            a[...] = whole[at : at + a.size].reshape(a.shape)
            at += a.size

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        """The sums of what each place's symbol adds."""
        return self._added(self.R @ self.C, contexts)

    def _added(self, tables: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        places = contexts.T.astype(np.int64)
        out = tables[0].take(places[0], axis=0)
        for j in range(1, CONTEXT):
            out += tables[j].take(places[j], axis=0)
        return out

    def log10_probabilities(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Normalised log probabilities of the symbols, by a matrix product per batch."""
        tables, outputs = self.R @ self.C, np.ascontiguousarray(self.Q.T)
        ones = np.ones(len(self.b), dtype=np.float32)
        block = np.empty((min(SCORED, len(symbols)), len(self.b)), dtype=np.float32)
        out = np.empty(len(symbols))
        for lo in range(0, len(symbols), SCORED):
            ctx, sym = contexts[lo : lo + SCORED], symbols[lo : lo + SCORED]
            logits = np.matmul(self._added(tables, ctx), outputs, out=block[: len(sym)])
            logits += self.b
            own = logits[np.arange(len(sym)), sym]
            top = logits.max()
            if top - logits.min() < 60:  # nothing gets too small beside the largest of the block
                logits -= top
            else:
                top = logits.max(axis=1)
                logits -= top[:, None]
            np.exp(logits, out=logits)
            p = np.exp((own - top).astype(np.float64)) / (logits @ ones)
            out[lo : lo + SCORED] = np.log10((1 - UNIGRAM_SHARE) * p + UNIGRAM_SHARE * self.noise[sym])
        return out


def _sums_by_symbol(symbols: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """For each line of symbols, which are bytes, the rows summed over equal symbols."""
    order = np.argsort(symbols, axis=1, kind="stable").ravel()
    places = symbols + size * np.arange(len(symbols))[:, None]
    counts = np.bincount(places.ravel(), minlength=len(symbols) * size)
    some = np.flatnonzero(counts)
    first = np.cumsum(counts)[some] - counts[some]
    out = np.zeros((len(counts), rows.shape[1]), dtype=np.float32)
    out[some] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out.reshape(len(symbols), size, -1)


class Trainer:
    """AdaGrad on the NCE objective."""

    def __init__(self, model: Model, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        self.squares = [np.full(a.shape, 0.1, dtype=np.float32) for a in model.arrays()]
        self.offset = np.log(NOISE * model.noise).astype(np.float32)
        self.cumulative = np.cumsum(model.noise)

    def _update(self, i: int, grad: np.ndarray) -> None:
        self.squares[i] += grad * grad
        self.model.arrays()[i][...] += RATE * grad / np.sqrt(self.squares[i])

    def step(self, contexts: np.ndarray, symbols: np.ndarray) -> None:
        """One gradient step. What depends on a symbol only is computed once per symbol: the
        contexts' share of the hidden vectors, and the sums of gradients over equal symbols."""
        m, size = self.model, len(self.model.b)
        h = m.hidden(contexts)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), size - 1)
        q, q_noise, bias = m.Q.take(symbols, axis=0), m.Q[noise], m.b - self.offset
        real = np.einsum("nd,nd->n", h, q) + bias.take(symbols)
        made = h @ q_noise.T
        made += bias[noise]
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the right limit
            up = 1 / (1 + np.exp(real))  # 1 - P(data)
            np.exp(np.negative(made, out=made), out=made)
        made += 1
        down = np.divide(-1, made, out=made)
        grad_q = _sums_by_symbol(symbols.astype(np.uint8)[None], up[:, None] * h, size)[0]
        grad_b = np.bincount(symbols, weights=up, minlength=size).astype(np.float32)
        drawn = np.zeros((size, NOISE), dtype=np.float32)
        drawn[noise, np.arange(NOISE)] = 1
        grad_q += drawn @ (down.T @ h)
        grad_b += drawn @ (np.ones(len(down), dtype=np.float32) @ down)
        grad_h = np.multiply(up[:, None], q, out=q)
        grad_h += down @ q_noise
        per_context = _sums_by_symbol(np.ascontiguousarray(contexts.T), grad_h, len(m.R))
        grad_c = m.R.T @ per_context
        grad_r = (per_context @ m.C.transpose(0, 2, 1)).sum(axis=0)
        for i, g in enumerate((grad_r, grad_c, grad_q, grad_b)):
            self._update(i, g)

    def train(self, contexts: np.ndarray, symbols: np.ndarray, epochs: int = 1) -> None:
        """Batches of positions in random order."""
        for _ in range(epochs):
            order = self.rng.permutation(len(symbols))
            for lo in range(0, len(symbols), BATCH):
                some = order[lo : lo + BATCH]
                self.step(contexts.take(some, axis=0), symbols.take(some))


def positions(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with an end after each text, their contexts, where each text begins)."""
    counts = np.diff(first)
    at = first + np.arange(len(first))
    whole = np.full(len(symbols) + len(counts), END, dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole[np.arange(len(symbols)) + owner] = symbols
    inside = np.arange(len(whole)) - np.repeat(at[:-1], counts + 1)
    start = 1 + HEAD + CLASSES
    small = whole.astype(np.uint8)  # there are fewer than 256 symbols
    contexts = np.full((CONTEXT, len(whole)), start, dtype=np.uint8)
    for j in range(1, CONTEXT + 1):
        contexts[j - 1, j:] = np.where(inside[j:] >= j, small[: max(len(small) - j, 0)], start)
    return whole, np.ascontiguousarray(contexts.T), at


def encode(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every row of (id, text) as (row, id, symbols), its sums over words, and the hashes of the
    words beyond the dictionary. ``own`` holds the words' shares of their classes."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    base_total = math.log10(vocab.tokens + vocab.distinct + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        partition, done = TaskContext.get().partitionId(), 0
        end = math.log10(vocab.end_count + 1.0)
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                n = piece.num_rows
                words = tb.find_words(piece.column("text"), tb.NOT_SPACE)
                hashes, classes = words.hashes(), word_classes(words)
                symbol, count, found = vocab.look_up(hashes, classes)
                plain = np.log10(count + 1.0)
                own = np.where(symbol > HEAD, plain - vocab.class_base[np.maximum(symbol - 1 - HEAD, 0)], 0.0)

                def per_text(x: np.ndarray, first: np.ndarray = words.first) -> np.ndarray:
                    total = np.append(0, np.cumsum(x))
                    return total[first[1:]] - total[first[:-1]]

                tokens = words.counts() + 1
                rest = np.flatnonzero(~found)
                lists = np.searchsorted(rest, words.first).astype(np.int32)
                places, whole = pa.py_buffer(words.first.astype(np.int32)), pa.py_buffer(symbol.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(partition) << 40) + done + np.arange(n)),
                        piece.column("id"),
                        pa.Array.from_buffers(pa.binary(), n, [None, places, whole]),
                        pa.array(tokens, pa.int64()),
                        pa.array(per_text(found.astype(np.int64)) + (vocab.end_count > 0), pa.int64()),
                        pa.array(per_text(plain) + end - tokens * base_total),
                        pa.array(per_text(own)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes[rest].view(np.int64))),
                    ],
                    names=["row", "id", "symbols", "n_tokens", "n_known", "base_score", "own", "rest"],
                )
                done += n

    kind = df.schema["id"].dataType.simpleString()
    sums = "n_tokens long, n_known long, base_score double, own double, rest array<long>"
    return df.mapInArrow(lambda b: tb.tidy(rows(b)), f"row long, id {kind}, symbols binary, {sums}")


def spread(encoded: DataFrame, tokens: int, most: int) -> DataFrame:
    """The rows dealt evenly to tasks of about ``most`` of all ``tokens`` or fewer, as many as fill all
    cores once or more. A scan packs the files of a stored table into somewhat more tasks than there
    are cores, so that most cores wait for the last ones."""
    if tokens <= LEAST_POSITIONS:
        return encoded
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    return encoded.repartition(cores * -(-tokens // (most * cores)), "row")


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Train on all rows of ``encoded``; the parameters have a fixed size."""
    model = Model(vocab.unigram)
    if not vocab.tokens:
        return model
    context = encoded.sparkSession.sparkContext
    epochs = min(MOST_EPOCHS, -(-LEAST_POSITIONS // vocab.tokens))
    for number in range(rounds):
        shared = context.broadcast((vocab.unigram, model.flat()))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            unigram, parameters = shared.value
            own = Model(unigram)
            own.load(parameters)
            trainer = Trainer(own, seed=1000 * number + TaskContext.get().partitionId())
            tokens = 0
            for batch in batches:
                for piece in tb.slices(batch, "symbols"):
                    symbols, first = tb.text_buffers(piece.column("symbols"))
                    whole, contexts, _ = positions(symbols, first)
                    trainer.train(contexts, whole, epochs)
                    tokens += len(whole)
            if tokens:
                flat = own.flat().astype(np.float64) * tokens
                columns = [pa.array(range(len(flat)), pa.int32()), pa.array([tokens] * len(flat), pa.int64())]
                columns += [pa.array(flat[:, i]) for i in range(DIM)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "tokens", *(f"v{i}" for i in range(DIM))])

        schema = "row int, tokens long, " + ", ".join(f"v{i} double" for i in range(DIM))
        read = spread(encoded.select("row", "symbols"), vocab.tokens, TRAIN_TOKENS).select("symbols")
        trained = read.mapInArrow(rows, schema)
        sums = [(F.sum(f"v{i}") / F.sum("tokens")).alias(f"v{i}") for i in range(DIM)]
        averaged = trained.groupBy("row").agg(*sums).orderBy("row").toArrow()
        model.load(np.column_stack([averaged[f"v{i}"].to_numpy() for i in range(DIM)]))
    return model


def score(encoded: DataFrame, model: Model, counts: DataFrame, tokens: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every encoded row; ``tokens`` is about their size."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in tb.slices(batch, "symbols"):
                symbols, first = tb.text_buffers(piece.column("symbols"))
                whole, contexts, at = positions(symbols, first)
                total = np.append(0, np.cumsum(model.log10_probabilities(contexts, whole)))
                model_score = total[at[1:]] - total[at[:-1]] + piece.column("own").to_numpy()
                kept = piece.select(["row", "id", "n_tokens", "n_known", "base_score"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(model_score)], names=[*kept.schema.names, "score"])

    kind = encoded.schema["id"].dataType.simpleString()
    read = encoded.select("row", "id", "symbols", "n_tokens", "n_known", "base_score", "own")
    schema = f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double"
    scored = spread(read, tokens, SCORE_TOKENS).mapInArrow(lambda b: tb.tidy(rows(b)), schema)
    # Words beyond the dictionary: log10(c + 1) enters both scores; an unseen word adds nothing.
    rare = encoded.select("row", F.explode("rest").alias("h")).join(counts.select("h", "n"), "h")
    added = rare.groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.join(added, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def language_model(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, train and score: one row per row of ``df``."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    training = rows.filter(~held_out(F.col("id"))).select("text")
    texts = training.count()
    counts = stage(count_words(training), "lm-counts")
    vocab = vocabulary(counts, texts)
    encoded = stage(encode(rows, vocab), "lm-symbols")
    model = train(encoded.filter(~held_out(F.col("id"))), vocab)
    scored = score(encoded, model, counts, vocab.tokens)
    return scored.select(
        F.col("doc_id").alias(key),
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
