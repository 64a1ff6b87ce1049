"""The fixed values that results depend on, pinned: SQL oracles share them with the code."""

import hashlib

import pytest

from weakflow.functions import text
from weakflow.operators import pages, rules

PINNED = {
    "ERROR_PATTERNS": (pages.ERROR_PATTERNS, "dffe2afbe598cdb7"),
    "SECURITY_HEADERS": (pages.SECURITY_HEADERS, "5fed3f707473f39f"),
    "TECHNOLOGIES": (pages.TECHNOLOGIES, "2158496ab3a0649b"),
    "SUSPICIOUS_LINK_PARTS": (pages.SUSPICIOUS_LINK_PARTS, "ca6c4302c0d1cb17"),
    "KEYWORD_PHRASES": (rules.KEYWORD_PHRASES, "f8476ab472b20cf8"),
    "LABEL_ADVICE": (rules.LABEL_ADVICE, "7bc197b28da8a2ea"),
    "RISK_COLOURS": (rules.RISK_COLOURS, "461210bcd8d01daf"),
    "WORD_SEPARATORS": (text.WORD_SEPARATORS, "ebcf75dc973c2788"),
}


@pytest.mark.parametrize("name", PINNED)
def test_fixed_values_have_not_changed(name):
    value, digest = PINNED[name]
    assert hashlib.sha256(repr(value).encode()).hexdigest()[:16] == digest


def test_some_fixed_values_in_full():
    assert text.WORD_SEPARATORS == '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
    assert pages.ERROR_PATTERNS["xss"][0] == r"<script.*?>"
    assert rules.RISK_COLOURS == {"LOW": "green", "MEDIUM": "orange", "HIGH": "red"}
