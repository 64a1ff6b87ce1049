import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from test_operators import VOCABULARY, prose
from weakflow.llm import op7_toxicity, op8_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def english(rng, n):
    common = op8_quality.COMMON_WORDS["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    item = " ".join(VOCABULARY[100:120])
    texts = [english(rng, rng.randint(60, 200)) for _ in range(60)]
    for i in range(0, 60, 6):
        texts[i] = " ".join(w if rng.random() > 0.06 else "stupid" for w in texts[i].split())
    texts += [t.replace(" ", " changed ", 1) for t in texts[1:6]] + texts[7:9]  # near and exact copies
    texts += [english(rng, 80) + " " + item, english(rng, 900) + " " + item]  # over and under the share
    texts += [" ".join(w + "&&&$$$" for w in texts[10].split()), texts[11].upper(), "short", "", None, prose(rng, 20_000)]
    rows = [(i, t, "en" if i % 9 else rng.choice([None, "xx"]), "s", 1) for i, t in enumerate(texts)]
    rows += [rows[13], (14, texts[15], "en", None, None), (None, texts[16], "en", "s", 1), (None,) * 5]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i < 60 and i % 6 == 0)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item, folder


def test_every_stage_equals_plain_python(spark, tables):
    rows, item, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    grammar = op7_toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in rows if grammar.score(r[1]) < 0.5]
    assert len(left) < len(rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    wanted = [left]
    verdicts = brute.kept(
        [(r[1], r[2]) for r in left],
        op8_quality.COMMON_WORDS,
        op8_quality.MIN_CHARS,
        op8_quality.MIN_WORDS,
        op8_quality.MAX_CHAR_DISTANCE,
        op8_quality.MAX_WORD_DISTANCE,
    )
    left = [r for r, ok in zip(left, verdicts, strict=True) if ok]
    wanted.append(left)
    # Rows with one id are one document with several texts: link if any of their texts do.
    places = dict(enumerate(left))
    found, _ = brute.components({i: r[1] for i, r in places.items()})
    groups = {}
    for i, r in places.items():
        if r[0] is not None:
            groups.setdefault(r[0], set()).add(found[i])
    merged = {}
    for key in sorted(groups):
        twin = next((m for m, g in merged.items() if g & groups[key]), None)
        merged[key if twin is None else twin] = groups[key] | (merged.get(twin) or set())
    stay = set(merged)
    wanted.append(stay)

    got = docs
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        got = corpus_pipeline.stage(function(spark, got, folder), "test")
        here = got.collect()
        if number < 4:
            assert got.columns == docs.columns, name
        if number < 2:
            assert Counter(tuple(r) for r in here) == Counter(wanted[number]), name
        elif number == 2:
            ids = [r["doc_id"] for r in here if r["doc_id"] is not None]
            assert sorted(ids) == sorted(stay) and len(here) - len(ids) == sum(r[0] is None for r in left)
            before = here
        elif number == 3:
            clean = []
            for r in before:
                n, hit, _ = brute.contamination(r["text"], [(1, item)])
                if not (hit and 20 * hit >= n):
                    clean.append(tuple(r))
            assert len(clean) < len(before) and Counter(tuple(r) for r in here) == Counter(clean)
        else:
            assert Counter(tuple(r)[:5] for r in here) == Counter(clean)
            assert all(r["n_tokens"] == len(brute.words(r["text"])) + 1 <= r["bucket_length"] for r in here)
    assert len(names) == 5
    ran = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r) for r in ran.drop("source").collect()) == Counter(tuple(r) for r in got.drop("source").collect())


def test_empty_tables_pass_through(spark, tables, tmp_path):
    _, _, folder = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_stay(spark, tables):
    folder = tables[2]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.withColumn("_key", F.lit("k")).withColumn("_toxicity", F.lit(2.0)).withColumn("n_words", F.lit(-1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for number in (0, 1, 3):
        function = corpus_pipeline.STAGES[number][1]
        got, want = function(spark, clash, folder), function(spark, docs, folder)
        assert got.columns == clash.columns
        assert Counter(tuple(r)[: len(docs.columns)] for r in got.collect()) == Counter(map(tuple, want.collect()))
        assert got.filter("_key <> 'k' OR _toxicity <> 2 OR n_words <> -1").isEmpty()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
