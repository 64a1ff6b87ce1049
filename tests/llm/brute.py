"""Plain Python versions of what the operators compute."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


def words(s):
    return SPACED.findall(lower(s))


def fold(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def shingles(s, size=5):
    w = words(s)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(texts):
    """{id: smallest linked id} for {id: text}, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = sorted((find(a), find(b)))
            up[s] = r
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def contamination(text, items, window=13):
    w = ALPHANUMERIC.findall(lower(text))
    hit, names = set(), set()
    for name, item in items:
        own = ALPHANUMERIC.findall(lower(item))
        for at in range(max(1, len(own) - window + 1) if own else 0):
            part = own[at : at + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def base_scores(texts):
    """[(n_tokens, n_known, base_score)] in order, and the training tokens."""
    counts, ends = Counter(), 0
    for key, text in texts:
        if fold(key, 7) != 2:
            counts.update(words(text))
            ends += 1
    total = sum(counts.values()) + ends
    distinct = len(counts) + (ends > 0)
    out = []
    for _, text in texts:
        w = words(text)
        c = [counts[x] for x in w] + [ends]
        out.append((len(c), sum(n > 0 for n in c), sum(math.log10((n + 1) / (total + distinct + 1)) for n in c)))
    return out, total


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    repeated = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [s for s in text.split("\n") if SPACED.search(s)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def distance(p, q):
    """Jensen-Shannon distance of two histograms in bits."""
    if not sum(p) or not sum(q):
        return None
    total = 0.0
    for a, b in zip(p, q, strict=True):
        x, y = a / sum(p), b / sum(q)
        total += sum(v * math.log2(v / ((x + y) / 2)) / 2 for v in (x, y) if v)
    return math.sqrt(max(total, 0.0))


def histograms(text, listed):
    """(characters by class, common words and the rest) of a text."""
    import unicodedata

    text = text or ""
    chars = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            chars[0] += 1
        elif kind == "Lu":
            chars[1] += 1
        elif kind == "Nd":
            chars[2] += 1
        elif c in "#*$%&|<>":
            chars[3] += 1
        elif kind[0] in "PS":
            chars[4] += 1
        else:
            chars[5] += 1
    w = SPACED.findall(text)
    if listed is None:
        return chars, None
    return chars, [*(w.count(x) for x in listed), sum(x not in listed for x in w)]


def kept(rows, common, min_chars, min_words, max_char, max_word):
    """{place: kept} of (text, lang) rows: the base rules and the distances."""
    own = [histograms(t, common.get(lang)) for t, lang in rows]
    langs = {lang for _, lang in rows}

    def summed(which, lang):
        some = [h[which] for h, (_, k) in zip(own, rows, strict=True) if (lang is None or k == lang) and h[which]]
        return [sum(x) for x in zip(*some, strict=True)]

    references = {lang: (summed(0, lang), summed(1, lang) if lang in common else None) for lang in langs}
    out = []
    for (text, lang), (chars, wordy) in zip(rows, own, strict=True):
        n_words, *_, failed = quality(text)
        far = False
        if len(text or "") >= min_chars:
            far |= (distance(chars, references[lang][0]) or 0) > max_char
        if wordy and n_words >= min_words:
            far |= (distance(wordy, references[lang][1]) or 0) > max_word
        out.append(not failed and not far)
    return out


def url_parts(url):
    """(host, path, query): the host ends at ``/``, ``?`` or ``#``, the path at ``?`` or ``#``; the query
    is what follows the first ``?`` up to the next ``#``."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query
