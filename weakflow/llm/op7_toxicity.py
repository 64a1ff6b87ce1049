"""Toxicity by a weighted finite-state grammar over clauses.

A clause (text between marks of punctuation or line ends) that holds an insult or a threat is
read word by word by a cascade of five transducers, composed into one machine:

    lexicon      word          -> class (insult, threat, target, negation, report, other)
    report       insult/threat -> quoted insult/threat after a verb of saying
    negation     insult/threat -> denied insult/threat up to three words after a negation
    target       insult        -> aimed insult when a person stands close before it
    threat       threat        -> full threat when a person follows closely

The lexicon gives a word its weight. The other steps carry an affine weight: a factor on what
came before and a bonus. So a denied or quoted insult keeps a small share of its weight, however
heavy the word, and an aimed one grows; the results add up along the clause. The cascade without
the lexicon is compiled to one table of states and classes. Word classes exist for English,
French, German and Spanish. A word alone never scores outside of its clause. A text has two features, the sum of its clause scores and that sum per word;
a logistic curve over their logarithms gives the score from 0 to 1.

Learning: insult weights are log odds of a word in toxic against other labelled texts. A word
is learnt by its evidence alone: ``MIN_TEXTS`` toxic texts and log odds of ``MIN_ODDS``, however
small its share of the toxic texts; its weight shrinks with few texts, and several weak words of
a clause add up. The weights and the logistic curve are fitted on at most ``TRAINING_ROWS``
labelled texts, chosen by a hash of the id; equal texts count once. The curve sees each text
through weights learnt without that text's part, since a word of few texts would look better
than it is on those texts. Words of the fixed lists have a prior weight, which the labels
correct. Scoring reads the text only, and cuts words as learning does.

A NULL or empty text has no clause and gets the score of a text without a match. Repeated ids
stay separate rows; ties need no order, since every row is scored by itself. A very long text is
read whole, clause by clause. An empty table gives an empty one. A column named as the score is
replaced, other columns stay. Without labels the prior weights and a default curve are used.
"""

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.llm import textbytes as tb
from weakflow.sources.staging import stage

TRAINING_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0  # rows whose crc32(id) mod FOLDS is HELD_OUT are never learnt from
PARTS = 5  # parts of the training texts; the curve sees each with the weights of the others
MIN_TEXTS = 3  # toxic texts that a learnt word must occur in
MIN_ODDS = 3.0  # log odds that a learnt word must have
PRIOR_WEIGHT, PRIOR_ROWS = 2.0, 4.0
BLOCK_FROM = 0.5

# Seed words of the classes, for English, French, German and Spanish.
INSULTS = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown fool jerk imbecile vermin filth "
    "imbécile crétin abruti dummkopf trottel abschaum idiota imbécil estúpido"
).split()
THREATS = "kill hurt destroy murder shoot stab strangle beat attack".split()
TARGETS = (
    "you your yours u he him she her they them their his people everyone "
    "tu toi te vous il elle ils elles du dich dir ihr sie er euch tú vosotros usted ustedes él ella ellos ellas"
).split()
NEGATIONS = (
    "not no never none nobody nothing isn't aren't wasn't don't doesn't didn't won't without hardly "
    "pas jamais aucun aucune sans nicht kein keine keinen keiner nie niemals ohne nunca jamás ningún ninguna sin"
).split()
REPORTS = (
    "said says say saying called calls wrote writes claimed claims quoted reported alleged accused "
    "dit disait écrit écrivait prétend sagt sagte nannte schrieb behauptet behauptete dijo dice escribió afirmó"
).split()

QUOTED, DENIED, AIMED = 0.05, 0.05, 1.2  # what these operations leave of an insult's weight
FULL_THREAT = 2.5
KINDS = "IHTNRo"  # insult, threat, target, negation, report, other

Step = Callable[[int, str], tuple[int, str, float, float]]


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: step(state, symbol) gives the next state, the symbol
    written, and the factor and the bonus of its weight. It starts in state 0."""

    step: Step


def compose(first: Transducer, second: Transducer, states: int = 8) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``. Its state holds both states;
    ``second`` has fewer than ``states``. Weights compose as affine maps."""

    def step(state: int, symbol: str) -> tuple[int, str, float, float]:
        a, x, factor, bonus = first.step(state // states, symbol)
        b, y, scale, more = second.step(state % states, x)
        return a * states + b, y, factor * scale, bonus * scale + more

    return Transducer(step)


def report() -> Transducer:
    """After a verb of saying, insults and threats are quoted."""

    def step(state: int, s: str) -> tuple[int, str, float, float]:
        if s == "R":
            return 1, s, 1.0, 0.0
        return (1, s.lower(), QUOTED, 0.0) if state and s in "IH" else (state, s, 1.0, 0.0)

    return Transducer(step)


def negation(reach: int = 3) -> Transducer:
    """Up to ``reach`` words after a negation, insults and threats are denied."""

    def step(state: int, s: str) -> tuple[int, str, float, float]:
        if s == "N":
            return reach, s, 1.0, 0.0
        left = max(state - 1, 0)
        return (left, s.lower(), DENIED, 0.0) if state and s in "IHih" else (left, s, 1.0, 0.0)

    return Transducer(step)


def target(reach: int = 4) -> Transducer:
    """An insult up to ``reach`` words after a person is aimed."""

    def step(state: int, s: str) -> tuple[int, str, float, float]:
        if s == "T":
            return reach, s, 1.0, 0.0
        return max(state - 1, 0), s, AIMED if state and s == "I" else 1.0, 0.0

    return Transducer(step)


def threat(reach: int = 3) -> Transducer:
    """A threat neither denied nor quoted counts in full when a person follows within ``reach`` words."""

    def step(state: int, s: str) -> tuple[int, str, float, float]:
        if s == "H":
            return reach, s, 1.0, 0.0
        return (0, s, 1.0, FULL_THREAT) if state and s == "T" else (max(state - 1, 0), s, 1.0, 0.0)

    return Transducer(step)


def compiled(machine: Transducer) -> list[dict[str, tuple[int, float, float]]]:
    """For every state that can be reached and every class of word: (next state, factor, bonus)."""
    number, table = {0: 0}, []
    todo = [0]
    for state in todo:  # grows while states are found
        row = {}
        for kind in KINDS:
            to, _, factor, bonus = machine.step(state, kind)
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row[kind] = (number[to], factor, bonus)
        table.append(row)
    return table


def cascade() -> Transducer:
    machine = report()
    for further in (negation(), target(), threat()):
        machine = compose(machine, further)
    return machine


_TABLE = compiled(cascade())


_CLAUSE = re.compile(r"[^.,;:!?()\n]+")
_LETTERS = r"[0-9a-z\u0080-\U0010ffff]+"
_WORD = re.compile(rf"{_LETTERS}(?:'{_LETTERS})*")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    return text.translate(_ASCII_LOWER) if not text.isascii() else text.lower()


def words_of(clause: str) -> Iterator[str]:
    return map(re.Match.group, _WORD.finditer(clause))


@dataclass
class Grammar:
    """The composed machine with learnt weights, and the logistic curve over its features."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, PRIOR_WEIGHT))
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, 0.5))
    curve: tuple[float, float, float] = (-3.0, 3.0, 0.5)

    def __post_init__(self) -> None:
        classes = dict.fromkeys(TARGETS, ("T", 0.0)) | dict.fromkeys(NEGATIONS, ("N", 0.0))
        classes |= dict.fromkeys(REPORTS, ("R", 0.0))
        classes |= {w: ("H", v) for w, v in self.threats.items()} | {w: ("I", v) for w, v in self.insults.items()}
        self._lexicon = classes
        self._words = set(self.insults) | set(self.threats)

    def __getstate__(self) -> dict:
        return {"insults": self.insults, "threats": self.threats, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def clause_score(self, clause: str) -> float:
        state, total = 0, 0.0
        for word in words_of(clause):
            kind, weight = self._lexicon.get(word, ("o", 0.0))
            state, factor, bonus = _TABLE[state][kind]
            total += weight * factor + bonus
        return max(total, 0.0)

    def matched(self, text: str) -> list[tuple[str, float]]:
        """(clause, score) of the clauses with an insult or a threat."""
        clauses = (m.group() for m in _CLAUSE.finditer(lowered(text)))
        return [(c, self.clause_score(c)) for c in clauses if not self._words.isdisjoint(words_of(c))]

    def features(self, text: str | None) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        total = sum(s for _, s in self.matched(text))
        return math.log1p(total), math.log1p(1000 * total / max(50, len(text) / 5)) if total else 0.0

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def taught(weights: dict[str, float]) -> Grammar:
    """The grammar of the fixed lists with learnt weights."""
    grammar = Grammar()
    for word, weight in weights.items():
        (grammar.threats if word in THREATS else grammar.insults)[word] = weight
    return Grammar(grammar.insults, grammar.threats)


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, label, part) of at most about ``rows`` labelled texts outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = known.count()
    if n > rows:
        part = F.pmod(F.xxhash64(key, F.lit("toxicity")), F.lit(1 << 53))
        known = known.filter(part < int(rows / n * (1 << 53)))
    known = stage(known, "toxicity-labels")
    texts = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    # About ``rows`` ids at most: a broadcast of bounded size.
    found = texts.join(F.broadcast(known), key).select("text", "label")
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    return stage(found.dropDuplicates(["text", "label"]).select("text", "label", part), "toxicity-texts")


def word_odds(texts: DataFrame) -> list[dict[str, float]]:
    """Weights of the words that mark toxic texts: for each part of the texts those learnt
    without it, and last those of all texts."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                found = [sorted(set(_WORD.findall(lowered(t.as_py())))) for t in piece.column("text")]
                of = np.repeat(np.arange(len(found)), [len(words) for words in found])
                words = [w for words in found for w in words]
                columns = [pa.array(words, pa.string()), piece.column("part").take(of), piece.column("label").take(of)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "part", "label"])

    kinds = [(part, label) for part in range(PARTS) for label in (1, 0)]
    totals = np.zeros((PARTS, 2))
    for r in texts.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        totals[r["part"], 1 - r["label"]] = r["n"]
    without = [totals.sum(axis=0) - t for t in totals] + [totals.sum(axis=0)]

    def counts(label: int, left_out: int | None) -> Column:
        some = [F.col(f"n{p}_{label}") for p in range(PARTS) if p != left_out]
        return sum(some[1:], some[0])

    def odds(left_out: int | None) -> Column:
        toxic, other = without[PARTS if left_out is None else left_out]
        return F.log((counts(1, left_out) + 0.5) / (toxic + 1)) - F.log((counts(0, left_out) + 0.5) / (other + 1))

    is_kind = [((F.col("part") == p) & (F.col("label") == label)).cast("int") for p, label in kinds]
    sums = [F.sum(k).alias(f"n{p}_{label}") for k, (p, label) in zip(is_kind, kinds, strict=True)]
    counted = texts.mapInArrow(lambda b: tb.tidy(seen(b)), "word string, part int, label int").groupBy("word").agg(*sums)
    seeds = INSULTS + THREATS
    cuts = [*range(PARTS), None]
    toxic = {f"toxic{i}": counts(1, cut) for i, cut in enumerate(cuts)}
    marked = counted.select("word", *[c.alias(n) for n, c in toxic.items()], *[odds(c).alias(f"odds{i}") for i, c in enumerate(cuts)])
    enough = [(F.col(f"toxic{i}") >= MIN_TEXTS) & (F.col(f"odds{i}") >= MIN_ODDS) for i in range(len(cuts))]
    learnt = F.col("word").isin(*seeds)
    for e in enough:
        learnt = learnt | e
    # Each word stands in some of the bounded number of training texts.
    out: list[dict[str, float]] = [{} for _ in cuts]
    for r in marked.filter(learnt).orderBy("word").collect():
        seed = r["word"] in seeds
        for i, weights in enumerate(out):
            n, o = r[f"toxic{i}"], r[f"odds{i}"]
            if without[i].all() and (seed or (n >= MIN_TEXTS and o >= MIN_ODDS)):
                weights[r["word"]] = (o * n + PRIOR_WEIGHT * PRIOR_ROWS * seed) / (n + PRIOR_ROWS)
    return out


def fit_curve(features: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge; slopes are not negative."""
    x = np.column_stack([np.ones(len(features)), features])
    use = [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ w[use], -30, 30)))
            grad = x[:, use].T @ (labels - p) - 0.01 * w[use]
            hess = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 0.01 * np.eye(len(use))
            move = np.linalg.solve(hess, grad)
            w[use] += np.clip(move, -2, 2)
        worst = [i for i in use if i and w[i] < 0]
        if not worst:
            return tuple(float(v) for v in w)
        use.remove(worst[0])


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = TRAINING_ROWS,
) -> Grammar:
    texts = training_texts(docs, labels, key, text, label, rows)
    *partial, grammar = map(taught, word_odds(texts))
    shared = texts.sparkSession.sparkContext.broadcast(partial)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text"), batch.column("part").to_pylist(), strict=True)
            both = [shared.value[part].features(t.as_py()) for t, part in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64()),
                 batch.column("label")], names=["x", "y", "label"])

    # Three numbers for each of the bounded number of training texts.
    points = texts.mapInArrow(lambda b: tb.tidy(featured(b)), "x double, y double, label int").toArrow()
    y = points["label"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        xs = np.column_stack([points["x"].to_numpy(), points["y"].to_numpy()])
        order = np.lexsort((y, xs[:, 1], xs[:, 0]))  # sums do not depend on the order of tasks
        grammar.curve = fit_curve(xs[order], y[order])
    return grammar


def score(df: DataFrame, grammar: Grammar, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in tb.tidy(batches):
            yield pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return df.withColumn(out, scores(F.col(text).cast("string")))
