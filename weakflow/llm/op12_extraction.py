"""Main text of HTML pages by a tree-structured graphical model.

The nodes of a page's tree (elements and texts) are binary variables: content or not. Node potentials
come from a node's tag, its class, id and role words, its size and its share of link text; parent-child
potentials say how likely a node of a kind is content below a parent that is content or is not.
Sum-product message passing, once upwards and once downwards, gives exact marginals, and the texts whose
marginal is above one half are the main text. So a paragraph is judged with its neighbours and all that
is above it, not alone.

All potentials are frequencies counted by Spark on labelled pages: (html, text) rows, where a text of
the page is content if it stands in the text. At most ``TRAIN_PAGES`` labelled pages are used
(``label_pages`` takes those with the least hashes); their counts, at most ``TRUST`` observations for each potential, are added to the
fixed pseudo-counts below, so that menus, notices and comments of forms never seen in training are known.
What cannot be main text in any page is left out of the tree: scripts, styles, templates, the head,
embedded documents, and the controls of forms.

White space inside a block becomes one space, a line break is white space, and blocks are joined by \\n.
Tags are read in linear time, also in hostile pages: a tag whose quotes do not close ends at the next
``>``, and all later tags of that page are then read without regard to quotes.

Cases: a NULL or empty page has an empty text and 0 characters. NULL ids and urls stay. Repeated rows are
extracted each on its own. Very long or very deep pages are read whole, one at a time, without recursion.
A marginal of exactly one half is not content. Other columns are not read, whatever their names. Without
labelled pages the fixed pseudo-counts decide. An empty table gives no rows.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.sources.staging import stage

TRAIN_PAGES = 4_000
TRUST = 100.0  # observations that the labelled pages count for in one potential
SHARE = {"tag": 0.1, "size": 0.05, "link": 0.3}  # weights of what goes together in most nodes
ARTICLE_SHARE = 0.5  # weight of the tag article, since comments are marked up as articles, too
LABEL_WORDS = 3  # words that a text needs to be labelled by where it stands

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
HIDDEN = frozenset("button canvas datalist head math object option select svg template".split())
PARAGRAPHS = frozenset(
    "blockquote caption dd dl dt figcaption h1 h2 h3 h4 h5 h6 li ol p pre summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "address article aside body center details dialog dir div fieldset figure footer form header hgroup html "
    "legend main menu nav search section".split()
)
BLOCKS = PARAGRAPHS | CONTAINERS
SCOPES = frozenset("body button caption dl menu object ol table td template th ul".split())
# Pseudo-counts of tags and of class, id and role words that are mostly not main text, or are.
OTHER_TAGS = frozenset("aside dialog fieldset footer form header legend menu nav search".split())
MAIN_TAGS = frozenset("article body html main".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts alert author banner bio breadcrumb breadcrumbs byline comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disqus discussion feedback footer form gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice outbrain pagination pager popup "
    "privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola tags toc toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
PRIOR = (1.0, 400.0)  # pseudo-counts of a word for what it says and against it, reversed for main text
MAIN_PRIOR = (30.0, 1.0)
# Pseudo-counts of (parent, child) = (no, no), (no, yes), (yes, no), (yes, yes) per kind of child.
LINKS = {
    "container": (80.0, 3.0, 50.0, 50.0),
    "paragraph": (60.0, 1.0, 4.0, 60.0),
    "inline": (60.0, 0.5, 2.0, 60.0),
    "text": (60.0, 0.5, 2.0, 60.0),
}
ROOT = 3.0  # log odds of the root: nearly every page has a main text
LIMIT = 40.0  # bound of log odds

_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


@dataclass
class Page:
    """Nodes in page order, so that a parent stands before its children. ``text`` is None for elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words: tuple[str, ...], text: str | None, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def _attribute_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(html.unescape("".join(values))):
            found[word.lower()] = None
    return tuple(found)


class _Builder:
    """Turns tags and texts into nodes; ``scopes`` counts the open elements since each scope began."""

    def __init__(self) -> None:
        self.page = Page()
        self.page.add(-1, "html", (), None, 0)
        self.stack = [(0, "html")]
        self.scopes: list[Counter] = [Counter()]
        self.open: Counter = Counter()
        self.block = 0
        self.hidden = 0

    def put_text(self, text: str) -> None:
        if text and not self.hidden:
            self.page.add(self.stack[-1][0], "#text", (), text, self.block)

    def pop(self) -> str:
        _, tag = self.stack.pop()
        if tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        if tag in BLOCKS:
            self.block += 1
        return tag

    def close(self, *tags: str) -> None:
        """Close what is open in this scope up to one of the tags."""
        if any(self.scopes[-1][t] > 0 for t in tags):
            while self.pop() not in tags:
                pass

    def start(self, tag: str, words: tuple[str, ...]) -> None:
        if tag == "html":
            return  # the root stands already
        if tag in BLOCKS:
            while self.open["head"] > 0:
                self.pop()
            self.close("p")
            self.block += 1
        if tag == "li":
            self.close("li")
        elif tag in ("dt", "dd"):
            self.close("dt", "dd")
        elif tag in ("td", "th", "tr"):
            while self.stack[-1][1] != "table" and len(self.scopes) > 1 and self._cell():
                pass
            if tag == "tr":
                self.close("tr")
        node = self.page.add(self.stack[-1][0], tag, words, None, self.block)
        self.scopes[-1][tag] += 1
        self.open[tag] += 1
        self.hidden += tag in HIDDEN
        if tag in SCOPES:
            self.scopes.append(Counter())
        self.stack.append((node, tag))

    def _cell(self) -> bool:
        """Close an open cell of the same table."""
        outer = self.scopes[-2]
        if outer["td"] > 0 or outer["th"] > 0:
            while self.pop() not in ("td", "th"):
                pass
            return True
        return False

    def end(self, tag: str) -> None:
        if tag == "br":
            self.put_text(" ")
        elif self.open[tag] > 0:
            while self.pop() != tag:
                pass
        elif tag == "p":
            self.block += 1


def parse(source: str) -> Page:
    """The tree of a page. Hidden elements are nodes without texts."""
    builder = _Builder()
    at, size, quotes = 0, len(source), True
    texts: list[str] = []

    def flush() -> None:
        if texts:
            builder.put_text(html.unescape("".join(texts)))
            texts.clear()

    while at < size:
        opened = source.find("<", at)
        if opened < 0:
            texts.append(source[at:])
            break
        texts.append(source[at:opened])
        after = source[opened + 1 : opened + 2]
        if source.startswith("<!--", opened):
            stop = source.find("-->", opened + 2)
            at = size if stop < 0 else stop + 3
            continue
        closing = after == "/"
        name = _NAME.match(source, opened + 1 + closing)
        if name is None:
            if after in ("!", "?") or (closing and opened + 2 < size):
                stop = source.find(">", opened + 1)
                at = size if stop < 0 else stop + 1
            else:
                texts.append("<")
                at = opened + 1
            continue
        flush()
        stop = _QUOTED.match(source, name.end()) if quotes else None
        if stop is not None:
            at = stop.end()
        else:
            quotes = False
            found = source.find(">", name.end())
            at = size if found < 0 else found + 1
        tag = name.group().lower()
        if closing:
            builder.end(tag)
        elif tag in RAW:
            stop = _RAW_END[tag].search(source, at)
            at = size if stop is None else stop.start()
            if stop is not None:
                found = source.find(">", at)
                at = size if found < 0 else found + 1
        elif tag in VOID:
            if tag == "br":
                builder.put_text(" ")
            elif tag == "hr":
                builder.block += 1
        else:
            builder.start(tag, _attribute_words(source[name.end() : at]))
    flush()
    return builder.page


def kind(tag: str) -> str:
    if tag == "#text":
        return "text"
    return "container" if tag in CONTAINERS else "paragraph" if tag in PARAGRAPHS else "inline"


def features(page: Page) -> list[list[str]]:
    """The features of each node: tag, words, and steps of its size and of its share of link text. The
    words of html and body speak of the whole page and are left out."""
    count = len(page.tag)
    size, linked, in_link = [0] * count, [0] * count, [False] * count
    for i in range(count):
        in_link[i] = page.tag[i] == "a" or (i > 0 and in_link[page.parent[i]])
        if page.text[i] is not None:
            size[i] = len("".join(page.text[i].split()))
            linked[i] = size[i] if in_link[i] else 0
    for i in range(count - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    found = []
    for i in range(count):
        step = f"{min(size[i].bit_length(), 12) // 2}"
        of_kind = kind(page.tag[i])
        share = f"{4 * linked[i] // size[i]}" if size[i] else "-"
        words = page.words[i] if page.tag[i] not in ("html", "body") else ()
        found.append([f"tag {page.tag[i]}", f"size {of_kind} {step}", f"link {of_kind} {share}", *[f"word {w}" for w in words]])
    return found


def labels(page: Page, content: str) -> list[int | None]:
    """1 for content, 0 for other nodes, None where it cannot be told; elements go by most of their text.

    Texts of fewer than ``LABEL_WORDS`` words stand anywhere by chance. They are looked up together with
    their neighbours, from the least element that has enough words, unless that holds a longer text too."""
    squeezed = " ".join(content.split())
    count = len(page.tag)
    known: list[int | None] = [None] * count
    long_inside = [False] * count
    short: list[list[int]] = [[] for _ in range(count)]
    for i in range(count - 1, -1, -1):
        if page.text[i] is not None:
            words = page.text[i].split()
            if len(words) >= LABEL_WORDS:
                known[i] = int(" ".join(words) in squeezed)
                long_inside[i] = True
            elif words:
                short[i] = [i]
        elif long_inside[i]:
            short[i] = []
        else:
            words = [w for k in reversed(short[i]) for w in page.text[k].split()]
            if len(words) >= LABEL_WORDS:
                of_all = int(" ".join(words) in squeezed)
                for k in short[i]:
                    known[k] = of_all
                short[i] = []
                long_inside[i] = True
        if i:
            above = page.parent[i]
            long_inside[above] |= long_inside[i]
            short[above] += short[i]
            short[i] = []
    yes, no = [0] * count, [0] * count
    for i in range(count - 1, -1, -1):
        if page.text[i] is None:
            known[i] = int(yes[i] > no[i]) if yes[i] + no[i] else None
        elif known[i] is not None:
            yes[i], no[i] = (len(page.text[i]), 0) if known[i] else (0, len(page.text[i]))
        if i:
            yes[page.parent[i]] += yes[i]
            no[page.parent[i]] += no[i]
    return known


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for source, content in zip(batch.column("html"), batch.column("text")):
            page = parse(source.as_py() or "")
            known = labels(page, content.as_py() or "")
            for i, of_node in enumerate(features(page)):
                label = known[i]
                if label is None:
                    continue
                counts["all", label] += 1
                for f in of_node:
                    counts[f, label] += 1
                parent = known[page.parent[i]] if i else None
                if parent is not None:
                    counts[f"link of {kind(page.tag[i])}", 2 * parent + label] += 1
        names, which = zip(*counts) if counts else ((), ())
        columns = [pa.array(names, pa.string()), pa.array(which, pa.int32()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "which", "n"])


@dataclass(frozen=True)
class Model:
    """Log odds of features, and per kind of child (no, no), (no, yes), (yes, no), (yes, yes)."""

    weights: dict[str, float]
    links: dict[str, tuple[float, float, float, float]]


def _share(name: str) -> float:
    """How much a feature counts. Words, and tags that mean something, count in full. Size, links and
    plain tags repeat each other, and a page has many paragraphs, so they only tip the scales."""
    sort, value, *_ = name.split(" ")
    if (sort, value) == ("tag", "article"):
        return ARTICLE_SHARE
    return 1.0 if sort == "word" or (sort == "tag" and value in OTHER_TAGS | MAIN_TAGS) else SHARE[sort]


def model(counts: dict[tuple[str, int], int]) -> Model:
    """Frequencies of the labelled pages plus the fixed pseudo-counts."""
    prior = {f"tag {t}": PRIOR for t in OTHER_TAGS} | {f"word {w}": PRIOR for w in OTHER_WORDS}
    prior |= {f"tag {t}": MAIN_PRIOR for t in MAIN_TAGS} | {f"word {w}": MAIN_PRIOR for w in MAIN_WORDS}
    yes, no = counts.get(("all", 1), 0) + 1.0, counts.get(("all", 0), 0) + 1.0
    weights = {}
    for name in {n for n, _ in counts if n.startswith(("tag ", "word ", "size ", "link ")) and not n.startswith("link of ")} | set(prior):
        of_yes, of_no = counts.get((name, 1), 0) / yes, counts.get((name, 0), 0) / no
        seen = counts.get((name, 1), 0) + counts.get((name, 0), 0)
        trust = min(seen, TRUST) / (of_yes + of_no) if seen else 0.0
        more_yes, more_no = prior.get(name, (1.0, 1.0))
        weights[name] = _share(name) * math.log((of_yes * trust + more_yes) / (of_no * trust + more_no))
    links = {}
    for of_kind, fixed in LINKS.items():
        found = [counts.get((f"link of {of_kind}", k), 0) for k in range(4)]
        row = []
        for parent in (0, 2):
            total = found[parent] + found[parent + 1]
            trust = min(total, TRUST) / total if total else 0.0
            pair = [found[parent + k] * trust + fixed[parent + k] for k in (0, 1)]
            row += [p / sum(pair) for p in pair]
        links[of_kind] = tuple(row)
    return Model(weights, links)


def train(labelled: DataFrame, limit: int = TRAIN_PAGES) -> Model:
    """The model of (html, text) rows, at most ``limit`` of them."""
    chosen = stage(labelled.select("html", "text").limit(limit), "labelled")
    counted = chosen.repartition(64).mapInArrow(_count_pages, "name string, which int, n long").groupBy("name", "which").agg(F.sum("n").alias("n"))
    return model({(r["name"], r["which"]): r["n"] for r in counted.collect()})


def label_pages(pages: DataFrame, documents: DataFrame, number: Column, limit: int = TRAIN_PAGES) -> DataFrame:
    """(html, text) of at most ``limit`` different pages whose ``number`` is the id of a document.

    The pages are chosen first, so that only they are joined: a share of all hashes that holds some more
    than ``limit`` rows, and of these the least hashes, each once, however often its page is repeated."""
    numbered = pages.select("html", number.alias("doc_id")).filter("doc_id IS NOT NULL")
    numbered = numbered.withColumn("_hash", F.xxhash64("doc_id", "html"))
    share = 2.0 * limit / max(numbered.count(), 1)
    some = numbered.filter(F.pmod("_hash", F.lit(1 << 62)) < min(share, 1.0) * float(1 << 62))
    least = stage(some.select("_hash").distinct().orderBy("_hash").limit(limit), "chosen-hashes")
    chosen = some.join(F.broadcast(least), "_hash", "left_semi")  # at most ``limit`` numbers
    chosen = stage(chosen.groupBy("_hash", "doc_id").agg(F.first("html").alias("html")).drop("_hash"), "chosen-pages")
    wanted = F.broadcast(chosen.select("doc_id").distinct())  # at most ``limit`` ids
    texts = documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return chosen.join(texts, "doc_id").select("html", "text")


def marginals(page: Page, known: Model) -> list[float]:
    """The log odds of each node being content, by messages up and down the tree."""
    belief = [sum(known.weights.get(f, 0.0) for f in of_node) for of_node in features(page)]
    belief[0] += ROOT
    count = len(belief)
    links = [known.links[kind(t)] for t in page.tag]
    up = [0.0] * count
    for i in range(count - 1, 0, -1):
        no_no, no_yes, yes_no, yes_yes = links[i]
        odds = math.exp(max(-LIMIT, min(LIMIT, belief[i])))
        up[i] = math.log((yes_no + yes_yes * odds) / (no_no + no_yes * odds))
        belief[page.parent[i]] += up[i]
    for i in range(1, count):
        no_no, no_yes, yes_no, yes_yes = links[i]
        odds = math.exp(max(-LIMIT, min(LIMIT, belief[page.parent[i]] - up[i])))
        belief[i] += math.log((no_yes + yes_yes * odds) / (no_no + yes_no * odds))
    return belief


def main_text(source: str, known: Model) -> str:
    page = parse(source)
    blocks: dict[int, list[str]] = {}
    for i, odds in enumerate(marginals(page, known)):
        text = page.text[i]
        if text is not None and (odds > 0 or text.isspace()):
            blocks.setdefault(page.block[i], []).append(text)
    return "\n".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame, known: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    read = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", known) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            columns.append(pa.array([len(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = read.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return read.mapInArrow(run, schema)
