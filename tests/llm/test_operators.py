import gzip
import hashlib
import io
import pathlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from weakflow.llm import (
    op1_lm,
    op2_decontamination,
    op3_token_blocks,
    op4_warc,
    op5_urls,
    op6_packing,
    op7_toxicity,
    op8_quality,
    op9_jaccard,
    op10_sharding,
    queries,
    textbytes,
)

VOCABULARY = [f"w{i}" for i in range(400)] + ["É", "naïve,", "日本", "don't", "A.B.", "x"]
COLUMNS = "doc_id long, text string, lang string, source string, n long, score double, bucket int, id int"


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_rows(seed=3):
    """NULLs in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n\x0b ", "one", "A b c d", base, base, " ".join(near), base.upper(), prose(rng, 30_000)]
    texts += [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    texts += ["the same line\n" * 30, "\n".join([prose(rng, 9)] * 2 + [prose(rng, 70)])]
    rows = [(i, t, rng.choice(["en", "fr", None, "xx"]), rng.choice(["s", "s", "t", None]), 1, 0.5, 7, 9) for i, t in enumerate(texts)]
    rows += [rows[5], rows[20], rows[20], (None, base, None, None, None, None, None, None), (None,) * 8]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é日 \t\n\x0b,-\x00\x7f\x80", max_size=30)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((textbytes.NOT_SPACE, brute.SPACED), (textbytes.ALPHANUMERIC, brute.ALPHANUMERIC)):
        found = textbytes.find_words(pa.array(texts, pa.string()), table)
        strings = found.strings(np.arange(len(found.start))).to_pylist()
        expected = [pattern.findall(brute.lower(t)) for t in texts]
        assert [strings[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)] == expected
        hashes = found.hashes().tolist()
        assert len(set(zip(strings, hashes, strict=True))) == len(set(hashes)) == len(set(strings))


def test_language_model_base_scores(spark, odd, empty):
    rows, df = odd
    expected, total = brute.base_scores([(r[0], r[1]) for r in rows])
    got = op1_lm.language_model(df).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2], round(r[3], 6))
    want = sorted((key((r[0], *e)) for r, e in zip(rows, expected, strict=True)))
    assert sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"])) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["held_out"] == (brute.fold(r["doc_id"], 7) == 2) and r["score"] < 0 for r in got)
    assert op1_lm.language_model(empty).collect() == []


def test_language_model_is_normalised_and_learns(spark, monkeypatch):
    monkeypatch.setattr(op1_lm, "DICTIONARY_WORDS", 60)  # most words take the join
    rng = random.Random(1)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op1_lm.language_model(df).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the kind shows in the context
    expected, _ = brute.base_scores(rows)
    assert all(abs(r["base_score"] - expected[r["doc_id"]][2]) < 1e-6 for r in got)
    model = op1_lm.Model(np.arange(1 + op1_lm.HEAD + op1_lm.CLASSES, dtype=float))
    contexts = np.full((len(model.b), op1_lm.CONTEXT), 3)
    assert np.isclose((10 ** model.log10_probabilities(contexts, np.arange(len(model.b)))).sum(), 1, atol=1e-4)


ITEMS = [(1, "w1 w2 w3"), (22, None), (3, ""), (4, " ".join(VOCABULARY[50:70])), (5, "É x"), (None, "w7"), (1, "x w5")]


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(op2_decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(textbytes, "SLICE_BYTES", 2000)
    rows, df = odd
    planted = [(900, "a, " + " ".join(VOCABULARY[52:68]).upper() + "! w1 w2 w3 w1 w2"), (901, "w1-w2\nw3")]
    df = df.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    # Items without an id count for the hits and are not listed.
    every = [(f"none {k}" if i is None else i, t) for k, (i, t) in enumerate(ITEMS)]
    want = Counter()
    for key, text in [(r[0], r[1]) for r in rows] + planted:
        n, hit, names = brute.contamination(text, every)
        names = [x for x in names if not str(x).startswith("none")]
        want[key, n, hit, len(names), op2_decontamination.digest(names), hit > 0 and 20 * hit >= n] += 1
    got = op2_decontamination.contamination(df, items)
    assert bag(got, *got.columns) == want
    assert bag(op2_decontamination.contamination(empty, items)) == Counter()
    none = op2_decontamination.contamination(df, items.limit(0))
    assert none.count() == len(rows) + 2 and none.filter("n_hit > 0 OR contaminated").count() == 0


def test_blocks_of_items_meet_under_any_plan(spark, odd, monkeypatch):
    """Each block's search is planned with other splits, as if executors had come or gone."""
    monkeypatch.setattr(textbytes, "SLICE_BYTES", 2000)
    monkeypatch.setattr(op2_decontamination, "SEGMENTS_PER_FILE", 1)
    _, df = odd
    items = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(40)] + [(99, " ".join(VOCABULARY[50:70]))], "item_id long, text string")
    df = df.unionByName(spark.createDataFrame([(700 + i, f"x w{i} w{i + 1} y w7 w8") for i in range(38)], "doc_id long, text string"), allowMissingColumns=True)
    once = op2_decontamination.contamination(df, items)
    want = bag(once, *once.columns)
    searches = []
    search = op2_decontamination.search

    def planned_anew(*args):
        searches.append(1)
        spark.conf.set("spark.sql.files.minPartitionNum", 1 if len(searches) % 2 else 40)
        return search(*args)

    monkeypatch.setattr(op2_decontamination, "search", planned_anew)
    monkeypatch.setattr(op2_decontamination, "BLOCK_BYTES", 600)
    try:
        got = op2_decontamination.contamination(df, items)
        assert bag(got, *got.columns) == want and sum(n for r, n in want.items() if r[2]) > 30
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(searches) > 2


def test_proximity():
    segment = op2_decontamination.Segment(
        op2_decontamination._segment(pa.array([1, 2]), pa.array(["a x b y c", "a q q q q q b"]), 1024)
    )
    asked = op2_decontamination.Phrases([("i", "a b")], 13)
    terms = segment.find_terms(asked.hashes, asked.terms)
    assert len(op2_decontamination.proximity_matches(segment, terms, 2)) == 1
    assert len(op2_decontamination.proximity_matches(segment, terms, 6)) == 2
    assert len(op2_decontamination.phrase_starts(segment, terms)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    values = np.array(values, dtype=np.uint32)
    part = op3_token_blocks.pack(values)
    assert (op3_token_blocks.unpack(part) == values).all() and len(op3_token_blocks.unpack(part)) == len(values)
    for b in range(-(-len(values) // op3_token_blocks.BLOCK)):
        own = values[b * op3_token_blocks.BLOCK : (b + 1) * op3_token_blocks.BLOCK]
        assert (op3_token_blocks.read_block(part, b) == own).all()


def test_token_files(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(op3_token_blocks, "PART_TOKENS", 3000)
    rows, df = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(5000, "it's John's. <|endoftext|>. a<|ENDOFTEXT|>b don't.' end'"), (5001, "é.́ a≠ İ ΣΑΣ. ß x日本。语, 1234.5!")]
    df = df.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    plain = Tokenizer.from_file(path)
    want = Counter()
    for key, text in [(r[0], r[1]) for r in rows] + extra:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, op3_token_blocks.END_ID]
        want[key, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    stored = op3_token_blocks.write_parts(df, path)
    got = op3_token_blocks.read_documents(spark, stored).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    known = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert known == sorted(known)
    assert op3_token_blocks.read_documents(spark, op3_token_blocks.write_parts(empty, path)).collect() == []


def test_warc(spark, empty):
    rng = random.Random(2)
    large = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 4\r\n\r\n0\r\n\r\n" + prose(rng, 300)
    pages = [(1, "http://a/", large), (2, None, large), (2, "u\r\nX: y", large), (3, "x", None), (4, "x", "")]
    pages += [(5, "s", "short"), (6, "s", "short"), (None, "n", large), (7, "b", "日本é" * 40_000), (8, "c", "日本é" * 40_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    path = op4_warc.write_archive(df)
    got = op4_warc.read_archive(spark, path)
    want = Counter()
    last = {}
    for key, _, html in pages:
        if key is not None and len((html or "").encode()) >= 1000:
            last[html] = max(key, last.get(html, key))
    for key, _, html in pages:
        data = (html or "").encode()
        to = last.get(html) if key is not None and html in last and last[html] > key else None
        want[key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to, "ok"] += 1
    assert bag(got, *got.columns) == want
    payloads = {r["page"]: bytes(r["payload"]) for r in op4_warc.read_payloads(spark, path).filter("record_type = 'response'").collect()}
    assert payloads["8"] == ("日本é" * 40_000).encode()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op4_warc.read_archive(spark, op4_warc.write_archive(none)).collect() == []


def test_warc_reports_broken_segments():
    block = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    digest = hashlib.sha1(b"abcdef").hexdigest()
    rows = [{"page": "1", "record_type": "response", "number": 1, "block": block[:10], "total": None, "digest": digest},
            {"page": None, "record_type": None, "number": 2, "block": block[10:], "total": len(block), "digest": None}]
    whole = op4_warc._reassembled(pa.Table.from_pylist(rows[::-1]), True).to_pylist()[0]
    assert whole["status"] == "ok" and whole["payload"] == b"abcdef"
    rows[1]["total"] = 99
    assert op4_warc._reassembled(pa.Table.from_pylist(rows), True).to_pylist()[0]["status"] == "wrong total length"
    assert op4_warc._reassembled(pa.Table.from_pylist(rows[1:]), True).to_pylist()[0]["status"] == "segments missing"
    rows[1] |= {"total": len(block), "block": block[10:-1] + b"X"}
    assert op4_warc._reassembled(pa.Table.from_pylist(rows), True).to_pylist()[0]["status"] == op4_warc.CHANGED


def archives(path):
    return sorted(p for p in pathlib.Path(path).iterdir() if p.suffix == ".gz")


def test_warc_revisits_resolve_and_ids_are_texts(spark):
    """Ids with any characters come back, and what a revisit names is a response with its payload."""
    rng = random.Random(3)
    large, other = prose(rng, 300), prose(rng, 301)
    ids = ["", "a:b>", "é %", "z", "z", None, "m"]
    rows = [(i, "u", other if i == "m" else large) for i in ids]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    path = op4_warc.write_archive(df)
    got = op4_warc.read_archive(spark, path, key_type="string")
    told = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect())
    assert told == Counter([("", "revisit", "é %"), ("a:b>", "revisit", "é %"), ("z", "revisit", "é %"), ("z", "revisit", "é %"),
                            ("é %", "response", None), (None, "response", None), ("m", "response", None)])
    records = [r for f in archives(path) for r in op4_warc.parse_records(io.BytesIO(gzip.decompress(f.read_bytes())))]
    by_id = {f["warc-record-id"]: f for f, _ in records}
    assert len(by_id) == len(records)
    revisits = [f for f, _ in records if f["warc-type"] == "revisit"]
    for f in revisits:
        target = by_id[f["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["warc-payload-digest"] == f["warc-payload-digest"]
    assert len(revisits) == 4


@pytest.mark.parametrize("damage", ["changed", "cut inside the file", "cut inside a record", "framing", "no archive"])
def test_warc_reports_damaged_archives(spark, tmp_path, damage):
    rows = [(i, "u", f"page {i} " + "text " * 20) for i in range(6)]
    path = op4_warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    (file,) = archives(path)
    data = gzip.decompress(file.read_bytes())
    if damage == "changed":
        raw = gzip.compress(data.replace(b"page 4 text", b"page 4 tExt"))
    elif damage == "cut inside the file":
        raw = file.read_bytes()[:-30]
    elif damage == "cut inside a record":
        raw = gzip.compress(data[: data.index(b"page 4 text") + 20])
    elif damage == "framing":
        at = data.index(b"page 4 text")
        raw = gzip.compress(data[: at - 4] + b"zz" + data[at - 2 :])
    else:
        raw = b"not gzip"
    (tmp_path / "a.gz").write_bytes(raw)
    got = op4_warc.read_archive(spark, str(tmp_path)).collect()
    states = {r["page_id"]: r["status"] for r in got}
    if damage == "no archive":
        assert states == {None: op4_warc.BROKEN}
    elif damage.startswith("cut"):
        assert states.pop(None) == op4_warc.BROKEN and set(states) <= set(range(5)) and set(states.values()) <= {"ok"}
    else:
        assert states.pop(4) == {"changed": op4_warc.CHANGED, "framing": "wrong chunked framing"}[damage]
        assert states == {i: "ok" for i in (0, 1, 2, 3, 5)}


def test_url_rules_and_trees(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12#f", "https://x.org", "//x.org/a",
            "http://x.org/q", "ftp://b.com/fr/?a://c", "http://www.com/de/", "http://notexample.org/es/", "a://EXAMPLE.org?/es/", "http://d.net/z"]
    pages = [(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h"), (None, "http://x.org/q", "h")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string")
    labelled = [(f"http://good{i}.net/page/{i}", 0) for i in range(60)] + [(f"http://x{i}.win/a/b/{i}{i}{i}?q=1&r={i}&s=2", 1) for i in range(60)]
    model = op5_urls.train(spark.createDataFrame([*labelled, (None, 1), ("http://x", None)], "url string, bad int"))
    got = {r["url"]: r for r in op5_urls.judge(df, queries.URL_RULES, model).collect()}
    rules = {u: (got[u]["host"], got[u]["path"], got[u]["rule"]) for u in urls}
    assert rules[None] == rules[""] == rules["no scheme"] == rules["//x.org/a"] == ("", "", None)
    assert rules["HTTP://A.Example.ORG/es/1?x"] == ("a.example.org", "/es/1", "example.org/es/")
    assert rules["http://example.org/en/12#f"] == ("example.org", "/en/12", "example.org/en/1")
    assert rules["https://x.org"] == ("x.org", "", None) and rules["http://x.org/q"][2] == "org/"
    assert rules["ftp://b.com/fr/?a://c"] == ("b.com", "/fr/", "com/fr/")
    assert rules["http://notexample.org/es/"][2] == "org/" and rules["a://EXAMPLE.org?/es/"] == ("example.org", "", None)
    assert got["http://www.com/de/"]["verdict"] == "block" and got["http://x.org/q"]["verdict"] == "allow"
    assert op5_urls.judge(df, queries.URL_RULES, model).count() == len(pages)
    unseen = spark.createDataFrame([("http://good99.net/page/99", 0), ("http://y77.win/a/b/777?q=1&r=7&s=2", 1)], "url string, bad int")
    verdicts = {r["bad"]: r["verdict"] for r in op5_urls.judge(unseen, [], model).collect()}
    assert verdicts == {0: "allow", 1: "block"}
    untrained = op5_urls.train(spark.createDataFrame([], "url string, bad int"))
    assert {r["verdict"] for r in op5_urls.judge(unseen, [], untrained).collect()} == {"allow"}
    assert op5_urls.judge(df.limit(0), [], model).count() == 0


def test_url_suffixes_are_all_counted(spark):
    """100 suffixes, more pages than labelled URLs, and a sample smaller than the labelled rows."""
    labelled = [(f"http://h.s{s:03d}/{i:02d}", s % 2) for s in range(100) for i in range(6)]
    pages = [(u,) for u, _ in labelled] + [(f"http://other.s{s:03d}/", ) for s in range(100) for _ in range(s)] + [(None,), ("http://h.new/",)]
    model = op5_urls.train(
        spark.createDataFrame(labelled, "url string, bad int"), rows=300, pages=spark.createDataFrame(pages, "url string")
    )
    got = {r["suffix"]: (r["suffix_share"], r["suffix_bad"]) for r in model.suffixes.collect()}
    assert set(got) == {f"s{s:03d}" for s in range(100)} | {"new", ""}
    for s in range(100):
        share, bad = got[f"s{s:03d}"]
        assert share == pytest.approx((6 + s) / len(pages)) and bad == pytest.approx((6 * (s % 2) + 5) / 16)
    unseen = spark.createDataFrame([(f"http://h.s{s:03d}/99", s % 2) for s in range(100)], "url string, bad int")
    judged = op5_urls.judge(unseen, [], model).collect()
    assert sum((r["verdict"] == "block") == (r["bad"] == 1) for r in judged) >= 95


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=8), st.integers(1, 5))
def test_bucket_boundaries_are_optimal(histogram, buckets):
    import itertools

    lengths = sorted(histogram)

    def padding(ends):
        return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())

    best = min(
        padding([*some, lengths[-1]]) for r in range(buckets) for some in itertools.combinations(lengths[:-1], r)
    )
    ends = op6_packing.boundaries(np.array(lengths), np.array([histogram[x] for x in lengths]), buckets)
    assert len(ends) <= buckets and padding(ends) == best


def test_packing(spark, odd, empty):
    rows, df = odd
    got = op6_packing.pack(df, op6_packing.token_count("text"), buckets=4, budget=600, rows_per_slice=5)
    found = got.collect()
    assert Counter((r["doc_id"], r["text"], r["n_tokens"], r["score"]) for r in found) == Counter(
        (r[0], r[1], len(brute.words(r[1])) + 1, r[5]) for r in rows
    )
    batches = {}
    for r in found:
        assert r["n_tokens"] + r["padding"] == r["bucket_length"] and r["padding"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), some in batches.items():
        assert sorted(r["place"] for r in some) == list(range(len(some)))
        assert len(some) == 1 or len(some) * some[0]["bucket_length"] <= 600
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(some) == max(1, 600 // some[0]["bucket_length"])
    assert op6_packing.pack(empty, op6_packing.token_count("text")).collect() == []


def test_grammar_scores_clauses():
    g = op7_toxicity.Grammar()
    score = g.clause_score
    assert score("you are an idiot") > score("an idiot") > score("he was called an idiot") > 0
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("i will kill you") > score("they kill time") and score("a nice day") == 0
    assert [c for c, _ in g.matched("Fine. You MORON, go; idiotic é")] == [" you moron"]
    assert g.score(None) == g.score("") == g.score("nothing here") < 0.5


@pytest.mark.parametrize(
    "plain, denied, quoted",
    [
        ("you are an idiot", "you are not an idiot", "he said you are an idiot"),
        ("tu es un idiot", "tu n'es pas un idiot", "il a dit que tu es un idiot"),
        ("du bist ein idiot", "du bist kein idiot", "er sagte du bist ein idiot"),
        ("tú eres un idiota", "no eres un idiota", "ella dijo que eres un idiota"),
    ],
)
def test_grammar_decides_in_four_languages(plain, denied, quoted):
    for weight in (2.0, 7.5, 20.0):  # however heavy the word
        g = op7_toxicity.Grammar(insults={"idiot": weight, "idiota": weight}, curve=(-3.0, 1.0, 0.6))
        assert g.score(plain) >= 0.5 > max(g.score(denied), g.score(quoted)), weight


def test_grammar_table_equals_plain_rules():
    g = op7_toxicity.Grammar()
    words = {"I": "moron", "H": "kill", "T": "you", "N": "not", "R": "said", "o": "tree"}
    weight = {"I": g.insults["moron"], "H": g.threats["kill"]}
    rng = random.Random(6)
    for _ in range(2000):
        kinds = rng.choices("IHTNRo", [3, 3, 3, 2, 1, 6], k=rng.randint(1, 12))
        total, threats = 0.0, []
        for i, kind in enumerate(kinds):
            quoted, denied = "R" in kinds[:i], "N" in kinds[max(0, i - 3) : i]
            if kind in "IH":
                factor = (op7_toxicity.QUOTED if quoted else 1) * (op7_toxicity.DENIED if denied else 1)
                aimed = kind == "I" and not quoted and not denied and "T" in kinds[max(0, i - 4) : i]
                total += weight[kind] * factor * (op7_toxicity.AIMED if aimed else 1)
                if kind == "H" and not quoted and not denied:
                    threats.append(i)
            elif kind == "T":
                if threats and i - threats[-1] <= 3:
                    total += op7_toxicity.FULL_THREAT
                threats.clear()
        assert np.isclose(g.clause_score(" ".join(words[k] for k in kinds)), total), kinds


def test_grammar_reads_whole_clauses():
    g = op7_toxicity.Grammar()
    filler = " o" * 300
    reported = f"he said{filler} idiot"
    assert g.matched(reported) == [(reported, g.clause_score(reported))]
    assert g.matched(reported)[0][1] < g.clause_score("idiot")
    assert g.matched("s" + "kill" * 150 + " you idiot")[0][1] == g.clause_score("you idiot")
    long = f"idiot{filler} moron{filler} scum"
    assert [s for _, s in g.matched(long)] == [g.clause_score("idiot moron scum")]
    assert g.matched("a" * 1_000_000 + filler * 1000) == []


def test_toxicity_learns_on_its_folds_only(spark, odd, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["zorgle", "stupid"])
        if op7_toxicity.FOLDS and brute.fold(i, 5) == 0:
            text.append("heldword")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    grammar = op7_toxicity.train(docs, marks)
    assert "zorgle" in grammar.insults and "heldword" not in grammar.insults
    got = {r["doc_id"]: r["score"] for r in op7_toxicity.score(docs, grammar).collect()}
    assert all((got[i] >= 0.5) == (t == 1) for i, t in labels)
    assert op7_toxicity.score(odd[1], grammar, out="s").count() == len(odd[0])
    untaught = op7_toxicity.train(empty, marks.limit(0))
    assert untaught.score("you stupid idiot") > 0.5 > untaught.score("hello")


def test_toxicity_learns_rare_words(spark):
    """Each insult stands in 8 of 400 toxic texts, and holds letters beyond ASCII."""
    rows = []
    for i in range(1600):
        rng = random.Random(i)
        text = [f"w{rng.randrange(200)}" for _ in range(30)]
        if i % 4 == 0:
            text[10:10] = [f"zörg{i // 4 % 50}x", "w3", f"blé{(i // 4 + 1) % 50}"]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = op7_toxicity.train(docs, docs)
    learnt = set(grammar.insults) - set(op7_toxicity.INSULTS)
    assert len(learnt) > 90 and all(w.startswith(("zörg", "blé")) for w in learnt)
    unseen = [(t, y) for i, t, y in rows if brute.fold(i, 5) == 0]
    right = [(grammar.score(t) >= 0.5) == (y == 1) for t, y in unseen]
    assert sum(right) > 0.95 * len(right)


def test_quality(spark, odd, empty):
    rows, df = odd
    got = op8_quality.score(df)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(got, *names) == Counter((r[0], *brute.quality(r[1])) for r in rows)
    assert got.filter("kept AND base_failed").count() == 0
    assert op8_quality.score(empty).collect() == []


def test_quality_rejects_odd_histograms(spark):
    rng = random.Random(6)
    common = op8_quality.COMMON_WORDS["en"]
    fine = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else "w" + rng.choice("abcdefg") * rng.randint(2, 9) for _ in range(150)), "en") for i in range(60)]
    junk = [(100, " ".join(f"{w}&&&$$$" for w in fine[0][1].split()), "en"), (101, fine[1][1].upper(), "en")]
    got = {r["doc_id"]: r["kept"] for r in op8_quality.score(spark.createDataFrame(fine + junk, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and not got[101] and all(got[i] for i in range(60))


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(5)
    for _ in range(200):
        query = np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64))
        others = []
        for _ in range(rng.integers(0, 12)):
            kept = query[rng.random(len(query)) < rng.choice([0.5, 0.9, 0.95])]
            others.append(np.unique(np.append(kept, rng.integers(0, 90, rng.integers(0, 6)).astype(np.uint64))))
        others = [o for o in others if len(o)]
        want = [i for i, o in enumerate(others) if 100 * len(np.intersect1d(o, query)) >= 80 * len(np.union1d(o, query))]
        assert sorted(op9_jaccard.divide_skip(query, others)) == want


@pytest.mark.parametrize("part_rows", [100_000, 3])
def test_jaccard_join(spark, monkeypatch, part_rows, odd, empty):
    monkeypatch.setattr(op9_jaccard, "PART_ROWS", part_rows)
    monkeypatch.setattr(op9_jaccard, "GROUP_BYTES", 2000)
    rng = random.Random(8)
    passage = prose(rng, 60)
    texts = {i: r[1] for i, r in enumerate(odd[0])}
    for group in range(6):  # near copies of near copies, and texts around one passage
        text = prose(rng, rng.choice([4, 9, 25, 200])).split()
        for _ in range(12):
            text = list(text)
            if rng.random() < 0.8:
                text[rng.randrange(len(text))] = rng.choice(VOCABULARY)
            texts[len(texts)] = " ".join(text)
    for _ in range(25):
        texts[len(texts)] = prose(rng, 20) + " " + passage + " " + prose(rng, rng.choice([1, 2, 90]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want, sizes = brute.components(texts)
    got = op9_jaccard.join(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    if part_rows > 3:
        rows, odd_df = odd
        found = op9_jaccard.join(odd_df).collect()
        assert len(found) == len(rows) and all(r["component_id"] is None for r in found if r["doc_id"] is None)
        assert op9_jaccard.join(empty).collect() == []


def test_sharding(spark, odd, empty):
    rows, df = odd
    shards = 7
    got = op10_sharding.interleave(df, shards=shards, rows_per_bucket=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    by = Counter((r["shard"], r["stratum"]) for r in got)
    for stratum, n in Counter(r["stratum"] for r in got).items():
        assert all(abs(by[s, stratum] - n / shards) <= 2 for s in range(shards))
    assert op10_sharding.interleave(empty).collect() == []
    again = op10_sharding.interleave(df.repartition(2), shards=shards, rows_per_bucket=50).select("doc_id", "size", "shard", "slot")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got)


def test_queries_are_registered():
    names = set(queries.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.oracle_sql()) <= names


def test_language_model_finds_words_behind_a_taken_place(monkeypatch):
    monkeypatch.setattr(op1_lm, "FRONT", 8)  # most words share a place of the front table
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 62, 200, dtype=np.uint64))
    counts = rng.integers(1, 50, len(keys))
    vocab = op1_lm.Vocabulary(keys, counts, np.zeros(len(keys), dtype=np.int64), np.zeros(1), np.zeros(1), 0, 0, 0)
    asked = np.concatenate([keys[::-1], keys + np.uint64(1)])
    _, count, found = vocab.look_up(asked, np.zeros(len(asked), dtype=np.int64))
    known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert count.tolist() == [known.get(h, 0) for h in asked.tolist()]
    assert found.tolist() == [h in known for h in asked.tolist()]


def test_url_sample_keeps_the_share_of_hot_urls(spark):
    """The bound holds, and equal rows count by their number, whatever their share of the table."""
    rows = [("http://hot.com/a", 1)] * 4000 + [("http://hot.com/a", 0)] * 2000 + [(f"http://h{i}.org/{i % 9}?x={i}", i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "url string, bad int").repartition(5)
    fits = []
    kept = op5_urls.stage

    def spy(table, name="stage"):
        stored = kept(table, name)
        if name == "url-training":
            fits.append(stored)
        return stored

    op5_urls.stage = spy
    try:
        for bound in (600, 50_000):
            assert op5_urls.train(df, rows=bound).trees is not None
    finally:
        op5_urls.stage = kept
    sample, whole = fits
    weights = {(r["url"], r["bad"]): r["weight"] for r in sample.select("url", "bad", "weight").collect()}
    assert abs(sum(weights.values()) - 600) < 80
    assert abs(weights["http://hot.com/a", 1.0] - 200) <= 1 and abs(weights["http://hot.com/a", 0.0] - 100) <= 1
    assert whole.agg({"weight": "sum"}).first()[0] == len(rows)


def test_url_features_match_a_plain_reading(spark):
    def plain(url):
        host, path, query = brute.url_parts(url)
        share = Counter(url)
        entropy = -sum(n / len(url) * np.log2(n / len(url)) for n in share.values()) if url else 0.0
        digits = sum(c in "0123456789" for c in url)
        return {
            "length": len(url),
            "depth": sum(s != "" for s in path.split("/")),
            "host_labels": len(host.split(".")),
            "digit_ratio": digits / max(1, len(url)),
            "entropy": entropy,
            "parameters": sum(p != "" for p in query.split("&")),
            "fragment": float("#" in url),
            "hyphens": host.count("-"),
        }

    urls = ["", "no scheme", "http://", "HTTP://EX-A.Com", "https://a-b.c.org/x//y1/?a=1&&b=2#f?g&h", "ftp://h?q=1&r#", "x://h#a?b=1", "http://h/" + "long9/" * 5000]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in op5_urls.lexical(df).collect():
        for name, value in plain(r["url"]).items():
            assert abs(r[name] - value) < 1e-9, (r["url"][:60], name, r[name], value)


def test_language_model_is_trained_and_scored_in_even_tasks(spark, monkeypatch, tmp_path):
    """A corpus stored in one file, or in files of uneven size, still takes all cores."""
    monkeypatch.setattr(op1_lm, "LEAST_POSITIONS", 1000)
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, f"a{i % 7} b{i % 5} c " * (i % 9 + 1)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tasks = []
    make = op1_lm.spread

    def watched(*args):
        dealt = make(*args)
        counts = dealt.groupBy(F.spark_partition_id()).count().collect()
        tasks.append((dealt.rdd.getNumPartitions(), max(r["count"] for r in counts), sum(r["count"] for r in counts)))
        return dealt

    monkeypatch.setattr(op1_lm, "spread", watched)
    got = op1_lm.language_model(df).collect()
    assert len(tasks) == op1_lm.ROUNDS + 1 and tasks[-1][2] == len(rows)
    assert all(n == cores and most < 2 * total / cores for n, most, total in tasks)
    monkeypatch.setattr(op1_lm, "SCORE_TOKENS", 500)
    op1_lm.language_model(df).collect()
    assert tasks[-1][0] > cores and tasks[-1][0] % cores == 0
    expected, total = brute.base_scores(rows)
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    have = sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"])) for r in got)
    assert have == sorted(key((r[0], *e)) for r, e in zip(rows, expected, strict=True))
    assert {r["train_tokens"] for r in got} == {total}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB9zé日., \n-!", max_size=40), max_size=8))
def test_word_classes_pass_trailing_marks(texts):
    words = textbytes.find_words(pa.array([*texts, "x" + "." * 30], pa.string()), textbytes.NOT_SPACE)
    expected = []
    for a, b in zip(words.start, words.end, strict=True):
        word = words.data[a:b].tobytes()
        plain = word.rstrip(b".,-!")
        last = plain[-1] if plain else None
        kind = 30 if last is None else last - 97 if 97 <= last <= 122 else 26 + last % 4 if last >= 128 else 30
        expected.append(kind * 2 + (len(plain) < len(word)))
    assert op1_lm.word_classes(words).tolist() == expected


def test_rows_are_summed_by_symbol_and_scores_hold_at_the_bounds():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    rows = rng.normal(size=(500, op1_lm.DIM)).astype(np.float32)
    expected = np.zeros((3, 11, op1_lm.DIM))
    for line, some in zip(expected, symbols, strict=True):
        np.add.at(line, some, rows.astype(np.float64))
    assert np.allclose(op1_lm._sums_by_symbol(symbols, rows, 11), expected, atol=1e-4)
    model = op1_lm.Model(np.arange(1 + op1_lm.HEAD + op1_lm.CLASSES, dtype=float))
    for scale in (1, 200):  # the second takes logits beyond what a float can hold as powers
        model.Q *= scale
        model.b += scale
        contexts = rng.integers(0, len(model.b), (300, op1_lm.CONTEXT)).astype(np.uint8)
        chosen = rng.integers(0, len(model.b), 300)
        logits = (model.hidden(contexts).astype(np.float64) @ model.Q.T.astype(np.float64)) + model.b
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits[np.arange(300), chosen]) / np.exp(logits).sum(axis=1)
        want = np.log10((1 - op1_lm.UNIGRAM_SHARE) * p + op1_lm.UNIGRAM_SHARE * model.noise[chosen])
        assert np.allclose(model.log10_probabilities(contexts, chosen), want, atol=1e-3)
