"""Queries over web pages: features, feature text, rules."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow.functions import markup, urls
from weakflow.operators import pages, rules
from weakflow.plans import fixtures as fx
from weakflow.plans.registry import Registry
from weakflow.schemas import FEATURES

registry = Registry()

# --- SQL fragments ---------------------------------------------------------------------

_PARTS = "'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?'"
_NETLOC = f"regexp_extract(url, {_PARTS}, 2)"
_PATH = f"regexp_replace(regexp_extract(url, {_PARTS}, 3), ';[^/]*$', '')"
_QUERY = f"regexp_extract(url, {_PARTS}, 4)"
SQL_URL_ANALYSIS = f"('domain ' || {_NETLOC} || ' path ' || {_PATH} || ' query ' || {_QUERY})"

_ATTRS = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_HIDDEN = (
    r"<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<template\b[^>]*>.*?(?:</template\s*>|\z)|<!--.*?(?:-->|\z)"
)
_TAG = rf"</?[a-z]{_ATTRS}>|<[!?][^>]*>"
_CDATA = r"<!\[CDATA\[(.*?)\]\]>"
_KEPT = r"\1"
# The references that occur in the pages; the ampersand comes last.
_REFERENCES = (
    ("&quot;", "'\"'"),
    ("&copy;", "'©'"),
    ("&middot;", "'·'"),
    ("&lt;", "'<'"),
    ("&gt;", "'>'"),
    ("&#39;", "''''"),
    ("&#233;", "'é'"),
    ("&eacute;", "'é'"),
    ("&#00000000233;", "'é'"),
    ("&#150;", "'–'"),
    ("&apos;", "''''"),
    ("&rarr;", "'→'"),
    ("&x", "'&x'"),
    ("&amp;", "'&'"),
)


def _decoded(expr: str) -> str:
    for name, char in _REFERENCES:
        expr = f"replace({expr}, '{name}', {char})"
    return expr


_BREAK = "chr(1)"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _content(html: str) -> str:
    marked = _decoded(f"regexp_replace({html}, '(?is){_HIDDEN}|{_CDATA}|{_TAG}', {_BREAK} || '{_KEPT}' || {_BREAK}, 'g')")
    nodes = f"list_transform(string_split({marked}, {_BREAK}), lambda s: trim(s, {_SPACES}))"
    return f"left(array_to_string(list_filter({nodes}, lambda s: s <> ''), ' '), 2000)"


_BODY = f"regexp_replace(html, '(?is){_HIDDEN}', {_BREAK}, 'g')"
_ATTRIBUTE = r"""[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?"""


def _attr(tag: str, name: str) -> str:
    start = rf"regexp_extract({tag}, '(?is)^<[a-z][-a-z0-9]*({_ATTRS})>', 1)"
    found = (
        f"list_filter(regexp_extract_all({start}, '{_ATTRIBUTE}'), lambda a: "
        rf"lower(regexp_extract(a, '^[^\s=]+')) = '{name}')[-1]"
    )
    raw = rf"regexp_replace({found}, '^[^\s=]+\s*=?\s*', '')"
    unquoted = (
        f"CASE WHEN substr({raw}, 1, 1) IN ('\"', '''') THEN substr({raw}, 2, length({raw}) - 2) "
        f"ELSE {raw} END"
    )
    return _decoded(unquoted)


_FORMS_LIST = rf"regexp_extract_all({_BODY}, '(?is)<form[\s/>].*?(?:</form\s*>|\z)')"
_FIELDS = rf"regexp_extract_all(f, '(?is)<(?:input|textarea)(?:[\s/]{_ATTRS})?>')"
_FIELD = (
    f"'input ' || lower(coalesce({_attr('i', 'type')}, 'text')) || ' ' || "
    f"lower(coalesce({_attr('i', 'name')}, ''))"
)
SQL_FORMS = (
    f"array_to_string(flatten(list_transform({_FORMS_LIST}, lambda f: list_concat("
    f"['form ' || lower(coalesce({_attr('f', 'method')}, 'get')) || ' ' || "
    f"coalesce({_attr('f', 'action')}, '')], list_transform({_FIELDS}, lambda i: {_FIELD})))), ' ')"
)
_ANCHORS = rf"regexp_extract_all({_BODY}, '(?is)<a(?:[\s/]{_ATTRS})?>')"
_SUSPICIOUS = " OR ".join(
    f"contains(h, '{w}')" for w in ("id=", "user=", "admin", "login", "upload")
)
SQL_LINKS = (
    f"array_to_string(list_transform(list_filter(list_transform(list_filter(list_transform("
    f"{_ANCHORS}, lambda a: {_attr('a', 'href')}), lambda h: h IS NOT NULL)[1:50], "
    f"lambda h: lower(h)), lambda h: {_SUSPICIOUS}), lambda h: 'link ' || h), ' ')"
)
_PATTERN_ROWS = [(k, p) for k, ps in pages.ERROR_PATTERNS.items() for p in ps]
SQL_ERRORS = (
    "array_to_string(list_filter(["
    + ", ".join(
        f"CASE WHEN regexp_matches(lower(html), {fx.quote(p)}) THEN '{k} pattern detected' END"
        for k, p in _PATTERN_ROWS
    )
    + "], lambda m: m IS NOT NULL), ' ')"
)


def _header(name: str) -> str:
    return f"lower(coalesce(list_filter(headers, lambda h: lower(h.k) = '{name}')[1].v, ''))"


_TECH = [
    "CASE WHEN contains(html, 'wp-content') OR contains(lower(html), 'wordpress') "
    "THEN 'wordpress' END"
]
_TECH += [
    f"CASE WHEN contains(lower(html), '{t}') THEN '{t}' END"
    for t in ("drupal", "joomla", "react", "angular", "vue")
]
_TECH += [
    f"CASE WHEN {_header('server')} <> '' THEN 'server ' || {_header('server')} END",
    f"CASE WHEN {_header('x-powered-by')} <> '' THEN 'powered-by ' || {_header('x-powered-by')} END",
]
SQL_TECHNOLOGIES = (
    "array_to_string(list_filter([" + ", ".join(_TECH) + "], lambda m: m IS NOT NULL), ' ')"
)
SQL_HEADERS = (
    "array_to_string(list_transform(headers, lambda h: lower(h.k) || ' ' || lower(h.v)), ' ')"
)
SQL_SECURITY = (
    "array_to_string(list_transform(list_filter(headers, lambda h: lower(h.k) IN ("
    + ", ".join(f"'{h}'" for h in pages.SECURITY_HEADERS)
    + ")), lambda h: h.k || ' ' || h.v || ' '), '')"
)
_OK = "fetch_error IS NULL"
SQL_FEATURES = f"""WITH {fx.SQL_PAGES},
features AS (SELECT page_id, url, {SQL_URL_ANALYSIS} AS url_analysis,
  CASE WHEN {_OK} THEN {SQL_HEADERS} ELSE '' END AS headers,
  CASE WHEN {_OK} THEN {_content('html')} ELSE '' END AS content,
  CASE WHEN {_OK} THEN {SQL_TECHNOLOGIES} ELSE '' END AS technologies,
  CASE WHEN {_OK} THEN {SQL_FORMS} ELSE '' END AS forms,
  CASE WHEN {_OK} THEN {SQL_LINKS} ELSE '' END AS links,
  CASE WHEN {_OK} THEN {SQL_ERRORS} ELSE 'connection error ' || fetch_error END AS errors,
  CASE WHEN {_OK} THEN {SQL_SECURITY} ELSE '' END AS security_headers
  FROM site)"""
_NAMED = (
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {f} <> '' THEN '{f} ' || {f} END" for f in FEATURES)
    + "], lambda m: m IS NOT NULL), ' ')"
)
_PHRASES = "".join(
    " || CASE WHEN "
    + " OR ".join(f"contains(lower(plain), '{w}')" for w in words)
    + f" THEN ' {phrase}' ELSE '' END"
    for words, phrase in rules.KEYWORD_PHRASES
)
SQL_TEXT = f"""{SQL_FEATURES},
plain AS (SELECT *, {_NAMED} AS plain FROM features),
texts AS (SELECT *, plain{_PHRASES} AS text FROM plain)"""


def sql_recommendations(label: str) -> str:
    def quoted(texts: tuple[str, ...]) -> str:
        return "[" + ", ".join(fx.quote(t) for t in texts) + "]"

    cases = [
        ("security_headers = ''", (rules.ADVICE_SECURITY_HEADERS,)),
        ("contains(lower(headers), 'server')", (rules.ADVICE_SERVER,)),
        ("contains(lower(forms), 'form')", (rules.ADVICE_FORMS,)),
    ]
    cases += [
        (" OR ".join(f"contains(lower({label}), '{w}')" for w in words), texts)
        for words, texts in rules.LABEL_ADVICE
    ]
    groups = ", ".join(f"CASE WHEN {c} THEN {quoted(t)} ELSE [] END" for c, t in cases)
    return f"flatten([{groups}])[1:5]"


# --- queries ---------------------------------------------------------------------------


@registry.add(
    "page_url",
    f"SELECT page_id, {_NETLOC} AS netloc, {_PATH} AS path, {_QUERY} AS query, "
    f"{SQL_URL_ANALYSIS} AS url_analysis FROM pages",
)
def page_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.netloc(url).alias("netloc"),
        urls.path(url).alias("path"),
        urls.query(url).alias("query"),
        urls.url_analysis(url).alias("url_analysis"),
    )


_BARE = "regexp_replace(url, '^https://', '')"
_FULL = (
    f"CASE WHEN starts_with({_BARE}, 'http://') OR starts_with({_BARE}, 'https://') "
    f"THEN {_BARE} ELSE 'https://' || {_BARE} END"
)


@registry.add(
    "url_normalize",
    f"""SELECT page_id, full_url, translate(regexp_extract(full_url, {_PARTS}, 2), '.:', '__')
  AS domain FROM (SELECT page_id, {_FULL} AS full_url FROM pages)""",
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https://", "")
    full = fx.table(spark, sf_dir, "pages").select("page_id", urls.with_scheme(bare).alias("full_url"))
    return full.withColumn("domain", urls.domain_key(F.col("full_url")))


@registry.add(
    "page_headers",
    f"""WITH {fx.SQL_PAGES} SELECT page_id, {SQL_HEADERS} AS headers_text,
  {SQL_SECURITY} AS security_headers FROM site""",
)
def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.col("headers")
    return fx.site_pages(spark, sf_dir).select(
        "page_id",
        pages.header_text(headers).alias("headers_text"),
        pages.security_headers(headers).alias("security_headers"),
    )


def _one_feature(name: str, sql: str, column: Callable[[], Column]) -> None:
    @registry.add(name, f"WITH {fx.SQL_PAGES} SELECT page_id, {sql} AS value FROM site")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shared = fx.site_pages(spark, sf_dir).withColumn("lower", F.lower("html"))
        shared = shared.withColumn("body", markup.without_hidden(F.col("html")))
        return shared.select("page_id", column().alias("value"))


_one_feature("page_text", _content("html"), lambda: pages.content(F.col("html")))
_one_feature(
    "page_technologies",
    SQL_TECHNOLOGIES,
    lambda: pages.technologies(F.col("html"), F.col("lower"), F.col("headers")),
)
_one_feature("page_forms", SQL_FORMS, lambda: pages.forms(F.col("body")))
_one_feature("page_links", SQL_LINKS, lambda: pages.suspicious_links(F.col("body")))
_one_feature("page_errors", SQL_ERRORS, lambda: pages.error_text(F.col("lower")))


@registry.add(
    "page_pattern_hits",
    f"WITH {fx.SQL_PAGES}, hits AS ("
    + " UNION ALL ".join(
        f"SELECT page_id, '{k}' AS type FROM site WHERE regexp_matches(lower(html), {fx.quote(p)})"
        for k, p in _PATTERN_ROWS
    )
    + ") SELECT type, count(*) AS hits, count(DISTINCT page_id) AS n_pages FROM hits GROUP BY type",
)
def page_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pages.page_pattern_hits(fx.site_pages(spark, sf_dir))
    per_page = hits.groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("type").agg(
        F.sum("n").alias("hits"), F.count(F.lit(1)).alias("n_pages")
    )


@registry.add(
    "page_failures",
    f"""WITH {fx.SQL_PAGES} SELECT page_id, 'connection error ' || fetch_error AS errors
FROM site WHERE fetch_error IS NOT NULL""",
)
def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = pages.page_features(fx.site_pages(spark, sf_dir))
    return features.filter(F.col("errors").startswith("connection error")).select("page_id", "errors")


@registry.add(
    "page_features",
    f"{SQL_FEATURES} SELECT page_id, url, "
    + ", ".join(f"md5({f}) AS {f}" for f in FEATURES)
    + " FROM features",
)
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = pages.page_features(fx.site_pages(spark, sf_dir))
    return features.withColumns({f: F.md5(f) for f in FEATURES})


@registry.add(
    "page_feature_text",
    f"{SQL_TEXT} SELECT page_id, md5(text) AS text_md5, length(text) AS text_length FROM texts",
)
def page_feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = pages.page_features(fx.site_pages(spark, sf_dir))
    text = features.select("page_id", rules.with_keywords(rules.named_features()).alias("text"))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"))


@registry.add(
    "risk_level",
    """SELECT l_orderkey, l_linenumber, l_discount * 10 AS confidence,
  CASE WHEN l_discount * 10 < 0.3 THEN 'LOW' WHEN l_discount * 10 < 0.6 THEN 'MEDIUM'
    WHEN l_discount * 10 < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk FROM lineitem""",
)
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).alias("confidence"),
        rules.risk_level(F.col("l_discount") * 10).alias("risk"),
    )


_LABEL_OF_PAGE = (
    "CASE "
    + " ".join(
        f"WHEN url LIKE '%/{lang}/%' THEN {fx.quote(name)}" for lang, name in fx.CLASS_OF_LANG.items()
    )
    + " ELSE 'Unknown' END"
)


@registry.add(
    "recommendations",
    f"""{SQL_FEATURES}, named AS (SELECT *, {_LABEL_OF_PAGE} AS label FROM features)
SELECT page_id, len({sql_recommendations('label')}) AS n,
  array_to_string({sql_recommendations('label')}, '; ') AS advice FROM named""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    label: Column = F.lit("Unknown")
    for lang, name in reversed(fx.CLASS_OF_LANG.items()):
        label = F.when(F.col("url").like(f"%/{lang}/%"), name).otherwise(label)
    advice = rules.recommendations(
        F.col("security_headers"), F.col("headers"), F.col("forms"), label
    )
    features = pages.page_features(fx.site_pages(spark, sf_dir)).withColumn("list", advice)
    return features.select(
        "page_id", F.size("list").alias("n"), F.array_join("list", "; ").alias("advice")
    )
