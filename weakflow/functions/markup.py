"""HTML expressions over a string column: visible text, elements and attributes.

Pages are read with regular expressions inside the JVM; no page leaves Spark for a
parser process. Possessive quantifiers, and tags that end at the next ``<`` outside of
quotes, keep hostile pages (unclosed tags or quotes) linear. ``\\u0001`` marks the places
where markup separated two pieces of text.
"""

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = "\u0001"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "    　"

# A tag cannot run past the next "<" outside of quotes, so each start looks at its own piece.
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_HIDDEN = (
    rf"<script\b{_ATTRIBUTES}>.*?(?:</script\s*>|\z)"
    rf"|<style\b{_ATTRIBUTES}>.*?(?:</style\s*>|\z)"
    rf"|<template\b{_ATTRIBUTES}>.*?(?:</template\s*>|\z)"
    r"|<!--.*?(?:-->|\z)"
)
_CDATA = r"<!\[CDATA\[((?:[^\]]++|\](?!\]>))*+)(?:\]\]>|\z)"  # its text is visible
# Second tag form: a tag with an unbalanced quote ends at the next ">".
_TAG = rf"</?[a-z]{_ATTRIBUTES}>|</?[a-z][^<>]*+>|<[!?][^<>]*+>"
_ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _entity_names() -> Column:
    """The HTML 5 names, in one small map per first character."""
    names: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        if name.endswith(";"):
            names.setdefault(name[0], {})[name[:-1]] = text
    # A foldable literal: evaluated once per query, not per row.
    return F.from_json(F.lit(json.dumps(names)), "map<string,map<string,string>>")


def _character(code: Column) -> Column:
    """The character of a numeric reference; 128-159 are read as Windows-1252, and a code that
    is no character is U+FFFD."""
    byte = F.substring(F.lit("".join(bytes([b]).decode("cp1252", "replace") for b in range(128, 160))), 1, 32)
    western = F.substr(byte, (code - 127).cast("int"), F.lit(1))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    wide = F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0"))
    own = F.decode(wide, "UTF-32")
    return F.when(code.between(128, 159) & (western != "\ufffd"), western).otherwise(own)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references become characters.

    An unknown name keeps its ampersand and loses its semicolon.
    """
    names = _entity_names()

    def decoded(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^[a-zA-Z][-.a-zA-Z0-9]*", 0)
        # Leading zeros say nothing; a longer number than any character has counts as impossible.
        decimal = F.regexp_extract(piece, r"^#0*+([0-9]++)", 1)
        zero = piece.rlike(r"^#(?:0++|[xX]0++)(?![0-9a-fA-F])")
        hexa = F.regexp_extract(piece, r"^#[xX]0*+([0-9a-fA-F]++)", 1)
        rest = F.regexp_replace(piece, r"^(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][-.a-zA-Z0-9]*);?", "")
        far = F.lit(1 << 30)
        of_decimal = F.when(F.char_length(decimal) > 9, far).otherwise(decimal.try_cast("long"))
        of_hexa = F.when(F.char_length(hexa) > 7, far).otherwise(F.conv(hexa, 16, 10).try_cast("long"))
        known = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
        return (
            F.when(i == 0, piece)
            .when(name != "", F.concat(F.coalesce(known, F.concat(F.lit("&"), name)), rest))
            .when(zero, F.concat(F.lit("\ufffd"), rest))
            .when(decimal != "", F.concat(_character(of_decimal), rest))
            .when(hexa != "", F.concat(_character(of_hexa), rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    whole = F.array_join(F.transform(F.split(text, "&"), decoded), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def without_hidden(html: Column) -> Column:
    """The page without scripts, styles, templates and comments."""
    return F.regexp_replace(html, f"(?is){_HIDDEN}", BREAK)


def visible_text(html: Column) -> Column:
    """Stripped text nodes joined by one space."""
    stripped = F.regexp_replace(html, f"(?is){_HIDDEN}|{_CDATA}|{_TAG}", f"{BREAK}$1{BREAK}")
    marked = decode_entities(stripped)
    nodes = F.transform(F.split(marked, BREAK), lambda s: F.btrim(s, F.lit(WHITESPACE)))
    return F.array_join(F.filter(nodes, lambda s: s != ""), " ")


def start_tags(html: Column, names: str) -> Column:
    """All start tags with one of the names (a regex alternation), as written."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>]){_ATTRIBUTES}>"), F.lit(0))


def elements(html: Column, name: str) -> Column:
    """Whole elements; one that is never closed runs to the end of the page."""
    pattern = rf"(?is)<{name}(?=[\s/>]){_ATTRIBUTES}>.*?(?:</{name}\s*>|\z)"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the first start tag in ``tag``: NULL if absent, '' if it has
    no value; the last one counts when it is repeated."""
    start = F.regexp_extract(tag, rf"(?is)^<[a-z][-a-z0-9]*({_ATTRIBUTES})>", 1)
    found = F.filter(
        F.regexp_extract_all(start, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name,
    )
    last = F.try_element_at(found, F.lit(-1))
    raw = F.regexp_replace(last, r"^[^\s=]+\s*=?\s*", "")
    quoted = F.substring(raw, 1, 1).isin('"', "'")
    value = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return decode_entities(value)
