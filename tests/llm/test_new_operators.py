"""Operators 11 to 13 against plain Python versions."""

import hashlib
import html as html_module
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weakflow.llm import op11_divergence, op12_extraction, op13_conversations, queries

from test_operators import COLUMNS, odd_rows, prose


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_audit(rows, min_docs, ranks):
    """rows: (text, lang, source)."""
    groups, docs, per = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))
        docs[lang].update(set(found))
        per[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted((s for l, s in groups if l == lang), key=lambda s: s.encode())
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: per[lang, s][t] for t in kept})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(per[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if per[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("min_docs,ranks,levels", [(30, 50, 8), (1, 3, 8), (2, None, 2)])
def test_divergence(spark, min_docs, ranks, levels):
    """Small tiles make several row tiles, whose trees are walked in pairs."""
    rng = random.Random(4)
    rows = odd_rows()
    rows += [(100 + i, prose(rng, rng.randint(0, 40)), "en", f"s{i % 11}", 0, 0.0, 0, 0) for i in range(60)]
    rows += [(0, "4 5 .", "none", s, 0, 0.0, 0, 0) for s in "xyz"]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = op11_divergence.audit(docs, min_docs, ranks, levels).collect()
    want = brute_audit([(r[1], r[2], r[3]) for r in rows], min_docs, ranks)
    assert sorted(tuple(r) for r in got) == want


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert op11_divergence.audit(empty).isEmpty()


def test_tree_holds_its_cells():
    rng = np.random.default_rng(1)
    for filled in (1, 40, 3000):
        cells = rng.choice(65536, filled, replace=False)
        bits, counts = op11_divergence.build_tree(cells >> 8, cells & 255, cells + 1)
        tree = op11_divergence.Tree(bits, counts)
        every = np.arange(65536)
        node = np.zeros(65536, dtype=np.int64)
        for level in range(8):
            row, column = (every >> 8) >> (7 - level) & 1, (every & 255) >> (7 - level) & 1
            node = np.where(
                row == 0,
                np.where(column == 0, tree.step(level, node, 0), tree.step(level, node, 1)),
                np.where(column == 0, tree.step(level, node, 2), tree.step(level, node, 3)),
            )
        found = np.where(node >= 0, counts[np.maximum(node, 0)], 0)
        wanted = np.zeros(65536, dtype=np.int64)
        wanted[cells] = cells + 1
        assert (found == wanted).all()


def test_long_division():
    for count, total, terms in ((0, 0, 1), (7, 10**13, 10**8), (10**13, 10**13, 1), (123456789, 987654321012, 77)):
        want = 1 + 10**9 * (count + 5) // (total + 5 * terms)
        got = op11_divergence.share_array(np.array([count]), np.array([total + 5 * terms]))
        assert got.tolist() == [want]


def damaged_rows(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def brute_repair(rows, mark):
    """Least (cost, audit) by trying every edit of every row, state by state."""
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]]
    for r in damaged_rows(rows):
        convs[r[0]].append(r[1:])
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            if not bare:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        numbers = [r[0] for r in turns if r[0] is not None]
        following = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

        def put_in(best):
            for _ in range(4):
                for state in list(best):
                    for to, name in ((2, "user"), (3, "assistant")):
                        if following.get((state, name[0])) == to:
                            c, a, lines = best[state]
                            best[to] = min(best.get(to, (10**9,)), (c + 5, a + "I", [*lines, f"{name}:"]))
            return best

        best = put_in({0: (0, "", [])})
        for (_, role, text), fault in zip(turns, faults):
            after = {}
            extra = 5 if fault == "truncated" else 0
            for state, (c, a, lines) in best.items():
                choices = [(state, 2, "D", None)]
                if fault in ("", "truncated"):
                    if (state, role[:1]) in following:
                        choices.append((following[state, role[:1]], extra, "K", f"{role}:{text}"))
                    for name in ("user", "assistant"):
                        if (state, name[0]) in following:
                            choices.append((following[state, name[0]], 1 + extra, "R", f"{name}:{text}"))
                for to, cost, letter, line in choices:
                    found = (c + cost, a + letter, lines if line is None else [*lines, line])
                    after[to] = min(after.get(to, (10**9,)), found)
            best = put_in(after)
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        out.append(
            (
                conv,
                max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
                *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
                cost,
                audit,
                hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def odd_conversations(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", None, "Go on!  ", "...", "é", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "ursula", "Assistant"]
    rows = []
    for conv in [*range(25), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else prose(rng, 4) + rng.choice([".", "", "?"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(777, k, rng.choice(["user", "user", "assistant", "system"]), rng.choice(texts) if k % 3 else prose(rng, 3) + ".") for k in range(120)]
    rows += [(778, 5, "user", "same.")] * 25 + [(779, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(30)]
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_repair(spark, bits):
    """Chunks of 4,096 and of 4 rows give the same repairs."""
    rows = odd_conversations(9)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    extra = table.selectExpr("*", "'x' AS mark", "1 AS place", "2 AS sid", "3 AS chunk")
    got = op13_conversations.repair(extra, op13_conversations.damage(extra), bits)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(rows, digest)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert op13_conversations.repair(empty, op13_conversations.damage(empty)).isEmpty()


def test_fix_up_stops_early_and_agrees():
    rng = random.Random(2)
    for _ in range(300):
        kinds = "".join(rng.choice("suaxUA-") for _ in range(rng.randint(1, 60)))
        new = op13_conversations._normal(op13_conversations._closed(*[rng.randint(0, 9) for _ in range(4)]))[0]
        old = op13_conversations.END
        begin, gain = op13_conversations._normal(op13_conversations.backward(kinds, old)[0])
        want = op13_conversations._normal(op13_conversations.backward(kinds, new)[0])
        got = op13_conversations.fix_up(kinds, old, new, begin, gain)
        assert got[:2] == want and got[2] <= len(kinds)
    long = op13_conversations.fix_up("ua" * 5000, (0, 10, 5, 0), (5, 5, 0, 5), *op13_conversations._normal(op13_conversations.backward("ua" * 5000, (0, 10, 5, 0))[0]))
    assert long[2] < 100


LONG = "Some words of a paragraph that goes on for a while and says things. " * 3
PAGES = [
    (
        '<html><body class="has-sidebar"><header><a href=/>Logo</a><h2>My site</h2></header><div id="cookie-notice">We use '
        f"cookies. <button>OK</button></div><main><h1>Title &amp; more</h1><p>{LONG}A</p><p>B <a href=x>link</a> <b>bold</b>"
        f"<br>next</p><ul><li>one two three<li>four</ul></main><aside><p>{LONG}</p></aside><section class=comments>"
        + f"<div class=comment><p>{LONG}</p></div>" * 8
        + f"<form><label>Name</label><textarea>x</textarea></form></section><footer><p>{LONG}</p></footer></body></html>",
        ["Title & more", f"{LONG}A", "B link bold next", "one two three", "four"],
    ),
    (
        f"<div class=page><ul class='menu'><li><a href=1>Home</a><li><a href=2>About us here</a></ul><div class=content>"
        f"<h2>T</h2><p>{LONG}A<p>x &lt;y&gt; &nbsp; z<script>if (a</p>b) </script><style>p{{}}</style><!-- no <p>no --><table>"
        f"<tr><td>c1<td>c2<tr><td>c3</table></div><div class=sidebar><p>{LONG}</p></div></div>",
        ["T", f"{LONG}A", "x <y> z", "c1", "c2", "c3"],
    ),
    (f"<article><p>{LONG}A</p><div class=advert>Buy {LONG}</div><p>{LONG}B</p><div class=share><a>Tweet</a></div></article>", [f"{LONG}A", f"{LONG}B"]),
]


def page_rows():
    rows = [(i, f"http://h/{i}", h) for i, (h, _) in enumerate(PAGES)]
    return rows + [(None, None, None), (8, "u", ""), (9, None, "plain < text"), rows[0], (10, "u", '<p title="a>never closed <p>words')]


def test_extraction_with_fixed_counts(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    known = op12_extraction.model({})
    got = {r["page_id"]: r for r in op12_extraction.extract(pages, known).collect()}
    for i, (_, blocks) in enumerate(PAGES):
        want = "\n".join(" ".join(b.split()) for b in blocks)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert (got[None]["text"], got[8]["text"], got[9]["text"], got[9]["url"]) == ("", "", "plain < text", None)
    assert op12_extraction.extract(pages.filter("false"), known).isEmpty()


def test_extraction_learns_from_labelled_pages(spark):
    """Boxes whose class says nothing are told apart by what the labelled pages hold in them."""
    rng = random.Random(5)
    labelled = []
    for _ in range(60):
        text, other = prose(rng, 40), prose(rng, 40)
        boxes = [f'<div class="zork"><p>{text}</p></div>', f'<div class="quux"><p>{other}</p></div>']
        rng.shuffle(boxes)
        labelled.append((f"<body>{''.join(boxes)}</body>", text))
    table = spark.createDataFrame(labelled, "html string, text string")
    known = op12_extraction.train(table)
    for source, text in labelled:
        assert op12_extraction.main_text(source, known) == " ".join(html_module.unescape(text).split())


def test_marginals_are_those_of_the_whole_distribution():
    """Messages against a sum over all labellings of a small tree."""
    known = op12_extraction.model({("tag p", 1): 9, ("tag p", 0): 2, ("all", 1): 20, ("all", 0): 20})
    page = op12_extraction.parse("<div><p>one <b>two</b></p><nav>x</nav></div>")
    unary = [sum(known.weights.get(f, 0.0) for f in fs) for fs in op12_extraction.features(page)]
    unary[0] += op12_extraction.ROOT
    count = len(unary)
    yes, total = np.zeros(count), 0.0
    for code in range(1 << count):
        y = [code >> i & 1 for i in range(count)]
        weight = np.exp(sum(u for u, on in zip(unary, y) if on))
        for i in range(1, count):
            weight *= known.links[op12_extraction.kind(page.tag[i])][2 * y[page.parent[i]] + y[i]]
        total += weight
        yes += weight * np.array(y)
    want = yes / total
    got = 1 / (1 + np.exp(-np.array(op12_extraction.marginals(page, known))))
    assert np.allclose(got, want)


def test_hostile_pages_take_linear_time():
    for source in ("<div>" * 20_000 + "x", "<a '" * 30_000, "<p><b>" * 10_000, "</p>" * 20_000, "<td>" * 10_000 + "<tr>" * 10_000, "<" * 50_000, "<!--" * 20_000, "&" * 50_000):
        op12_extraction.main_text(source, op12_extraction.model({}))


def test_extraction_of_the_given_pages(spark):
    """Held-out pages: their article, without the marks, is what the query returns."""
    sf = "/root/testdata/sf0.01"
    found = {r["page_id"]: r["text"] for r in queries.queries()["op12_main_text"](spark, sf).collect()}
    right = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        lines = re.sub(r"</?(?:p|h1)>", "\x00", re.sub(r"</?b>", "", inner.replace("<br>", " "))).split("\x00")
        lines = [" ".join(html_module.unescape(x).split()) for x in lines]
        right += found[r["page_id"]] == "\n".join(x for x in lines if x)
    assert right >= 0.99 * len(found)
