from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF, bag
from weakflow.functions.text import WORD_SEPARATORS, one_hot, tokenize
from weakflow.operators import tokens


def python_tokens(text):
    table = {ord(c): " " for c in WORD_SEPARATORS}
    return [w for w in text.lower().translate(table).split(" ") if w]


def test_tokenize_matches_python(spark):
    texts = ["", "  ", "!!!", "Don't STOP\tnow\nplease", "a\rb c", "Straße ÉTÉ x_y-z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.t for r in df.select(tokenize(F.col("text")).alias("t")).collect()]
    assert got == [python_tokens(t) for t in texts]
    kept = tokens.drop_empty_sequences(df.select(tokenize(F.col("text")).alias("tokens")), "tokens")
    assert kept.count() == 3


def test_every_separator_cuts_in_one_pass(spark):
    """Alone, in runs, at both ends, and beside characters that are special in patterns."""
    texts = [f"a{c}B{c}{c}1" for c in WORD_SEPARATORS] + [WORD_SEPARATORS, f"{WORD_SEPARATORS}x{WORD_SEPARATORS}", "a&&b^c", " x", "x ", "\U0001f600-é", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokenize(F.col("text")).alias("t"))
    assert all(r.t == (None if r.text is None else python_tokens(r.text)) for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "lambda" not in plan  # no map look-up per character, no function per word


def test_vocabulary_matches_python_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first, counts = {}, Counter()
    for r in docs.orderBy("doc_id").collect():
        for w in python_tokens(r.text):
            first.setdefault(w, len(first))
            counts[w] += 1
    order = sorted(counts, key=lambda w: (-counts[w], first[w]))
    df = docs.repartition(5).select("doc_id", tokenize(F.col("text")).alias("tokens"))
    counted = tokens.word_counts(df, "doc_id")
    vocab = tokens.vocabulary(counted).orderBy("idx").collect()
    assert [r.word for r in vocab] == order
    assert [r.idx for r in vocab] == list(range(2, len(vocab) + 2))
    named = df.withColumn("doc_id", F.format_string("d%09d", "doc_id"))
    by_name = tokens.vocabulary(tokens.word_counts(named, "doc_id")).orderBy("idx").collect()
    assert [r.word for r in by_name] == order


def test_word_counts_order_holds_for_large_document_numbers(spark):
    df = spark.createDataFrame(
        [(2**62, ["b", "a"]), (2**62 - 1, ["c", "b"]), (-5, ["z"])], "doc_id long, tokens array<string>"
    )
    got = {r.word: (r.first_doc, r.first_pos) for r in tokens.word_counts(df, "doc_id").collect()}
    assert got == {"a": (2**62, 1), "b": (2**62 - 1, 1), "c": (2**62 - 1, 0), "z": (-5, 0)}


def test_first_places_of_narrow_and_wide_document_numbers(spark):
    """The same places whether a number fits in 32 bits or not, also below zero and for NULL."""
    for numbers in ([-(1 << 31), -5, 0, 7, (1 << 31) - 1, None], [-(1 << 31) - 1, -5, 0, 7, 1 << 31, None]):
        rows = [(n, ["all", f"w{i}", "all", "some" if i > 1 else "few"]) for i, n in enumerate(numbers)]
        df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
        counted = tokens.word_counts(df, "doc_id")
        got = {r.word: (r.n, r.first_doc, r.first_pos) for r in counted.collect()}
        own = {f"w{i}": (1, n, None if n is None else 1) for i, n in enumerate(numbers)}
        assert got == own | {"all": (12, numbers[0], 0), "some": (4, 0, 3), "few": (2, numbers[0], 3)}
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert ("decimal" in plan) == (numbers[0] < -(1 << 31))


def test_encoding_keeps_whole_texts_and_only_padding_cuts(spark):
    vocab = spark.createDataFrame(
        [("the", 9, 2), ("x", 5, 3), ("y", 4, 4), ("rare", 1, 5)], "word string, n long, idx int"
    )
    words = (["the", "x", "zzz", "y", "rare"] * 100)[:]
    rows = [(i, words[:i]) for i in (0, 1, 299, 300, 301)] + [(1, ["x"]), (None, ["y", "rare"]), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    encoded = tokens.encode_sequences(df, vocab, num_words=5)
    code = {"the": 2, "x": 3, "y": 4}
    want = sorted(((d, [code.get(w, 1) for w in ws or []]) for d, ws in rows), key=repr)
    assert bag(encoded.select("doc_id", "ids")) == want
    by_doc = {r.doc_id: r.padded for r in tokens.pad_sequences(encoded.filter("doc_id > 1")).collect()}
    assert all(len(p) == 300 for p in by_doc.values()) and by_doc[301][:4] == [2, 3, 1, 4]
    assert by_doc[7] == [0] * 300 and by_doc[299][-1] == 0


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int").select(one_hot(F.col("y"), 3).alias("v"))
    assert [r.v for r in df.collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def test_text_keys_are_numbered_before_words_are_counted(spark, monkeypatch):
    plans = {}
    stage = tokens.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tokens, "stage", lambda df, name: plans.update({name: plan(df)}) or stage(df, name))
    docs = [("b", ["x", "y", "x"]), (None, ["z", "y"]), ("a", ["x", "w"]), ("a", ["w"]), ("c", None)]
    df = spark.createDataFrame(docs, "name string, tokens array<string>")
    got = bag(tokens.word_counts(df, "name"))
    assert got == bag(
        spark.createDataFrame(
            [("x", 3, "a", 0), ("y", 2, None, 1), ("z", 1, None, 0), ("w", 2, "a", 0)],
            "word string, n long, first_doc string, first_pos int",
        )
    )
    assert "SortAggregate" not in plans["word-counts"]
    assert tokens.word_counts(df.limit(0), "name").count() == 0
