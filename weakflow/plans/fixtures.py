"""The reference input tables, derived from the given test tables.

Each view uses every row of its source. The same views exist twice, as DataFrames and
as SQL common table expressions, so that both sides of a check are written separately.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Two sources carry a class of their own, so that a language does not name its class; one
# document has a class that nothing else has.
MIXED_SOURCES = ("src2", "src5")
MIXED_CLASS = " Improper Limitation of a Pathname to a Restricted Directory ('Path Traversal')"
RARE_CLASS = " Use of Hard-coded Credentials"

# Class names for documents by language (public CWE names, with their leading space).
CLASS_OF_LANG = {
    "en": " Improper Neutralization of Special Elements used in an SQL Command ('SQL Injection')",
    "fr": " Improper Neutralization of Input During Web Page Generation ('Cross-site Scripting')",
    "de": " Improper Authentication",
    "es": " Buffer Copy without Checking Size of Input ('Classic Buffer Overflow')",
}

# Markup appended to the pages, chosen by the form of their URL.
FORM_QUOTED = (
    '<form method="POST" action="/Login?a=1&amp;b=2"><input type="password" name="Pwd">'
    "<textarea name='Bio' title=\"x name=y\"></textarea></form>"
)
SQL_ERROR = (
    "<p>Warning: mysql_error near line 3 &lt;b&gt; &#39;x&#39; &#233;&eacute;</p>"
    "<p>it&apos;s &#150; &#00000000233; <![CDATA[raw ]] text]]> &rarr;</p>"
    '<!-- <a href="/admin/hidden">no</a> -->'
)
MANY_LINKS = (
    "<a href=/Item?ID=4>x</a>"
    + '<a href="/ok" class="k">k</a>' * 60
    + "<a href='/admin/late'>late</a><img src=\"x\" onerror=alert(1)>"
)
DISCLOSURE = (
    "<p>Server: nginx/1.2 ORA-01234 stack trace ..\\\\ ..// %2e%2e%2f</p>"
    '<div id=app class="wp-content">React and Vue, Angular</div><a HREF="/User?user=Al&amp;x">u</a>'
)
OPEN_FORM = (
    '<form action=/search><input name=q><input type="hidden" name="Token" value="a>b">'
    "Exception in x\rat line; Drupal Joomla document.cookie fatal error"
)
INJECTIONS = (
    ("%#top", FORM_QUOTED),
    ("%utm_source%", SQL_ERROR),
    ("%.html", MANY_LINKS),
    ("%/", DISCLOSURE),
    ("%?page%", OPEN_FORM),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cve_id, cwe_name, summary); one source has no labels and one has no summaries."""
    d = table(spark, sf_dir, "documents")
    label = F.concat(F.lit(" "), F.col("lang"), F.lit("/"), F.col("source"))
    return d.select(
        F.concat(F.lit("CVE-"), F.col("doc_id").cast("string")).alias("cve_id"),
        F.when(F.col("source") != "src7", label).alias("cwe_name"),
        F.when(F.col("source") != "src13", F.col("text")).alias("summary"),
    )


def cve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 13 columns; dates and impact values come from the order with the same number."""
    d = table(spark, sf_dir, "documents")
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")
    label = F.concat(F.lit(" "), F.col("lang"), F.lit("/"), F.col("source"))
    return d.join(o, "doc_id", "left").select(
        F.concat(F.lit("CVE-"), F.col("doc_id").cast("string")).alias("cve_id"),
        F.col("o_orderdate").alias("mod_date"),
        F.col("o_orderdate").alias("pub_date"),
        F.col("o_totalprice").alias("cvss"),
        F.col("n_chars").cast("int").alias("cwe_code"),
        F.when(F.col("source") != "src7", label).alias("cwe_name"),
        F.col("text").alias("summary"),
        F.col("lang").alias("access_authentication"),
        F.col("o_orderpriority").alias("access_complexity"),
        F.col("source").alias("access_vector"),
        F.col("o_orderstatus").alias("impact_availability"),
        F.col("o_orderstatus").alias("impact_confidentiality"),
        F.col("o_orderstatus").alias("impact_integrity"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("CVE-"), F.col("l_orderkey").cast("string")).alias("cve_id"),
        F.when(F.col("l_quantity") >= 3, part).alias("vulnerable_product"),
    )


def vendor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    suffix = F.when(F.col("p_size") > 45, F.lit(" v2")).otherwise("")
    return (
        li.join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(part, li.l_partkey == part.p_partkey)
        .select(
            F.col("s_name").alias("vendor"),
            F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), suffix).alias("product"),
        )
    )


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.when(F.col("s_acctbal") < 0, F.lit(" (closed)")).otherwise("")
    return table(spark, sf_dir, "supplier").select(F.concat("s_name", closed).alias("vendor"))


def corpus_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(f(spark, sf_dir) for f in (cve, products, vendor_product, vendors))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label) for the classifier."""
    label: Column = F.lit(None).cast("string")
    for lang, name in CLASS_OF_LANG.items():
        label = F.when(F.col("lang") == lang, name).otherwise(label)
    label = F.when(F.col("source").isin(*MIXED_SOURCES), MIXED_CLASS).otherwise(label)
    label = F.when(F.col("doc_id") == 3, RARE_CLASS).otherwise(label)
    return table(spark, sf_dir, "documents").select("doc_id", "text", label.alias("label"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, headers, fetch_error)."""
    url = F.col("url")
    extra: Column = F.lit("")
    for like, markup in reversed(INJECTIONS):
        extra = F.when(url.like(like), markup).otherwise(extra)

    def header(condition: Column, name: str, value: str) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("key"), F.lit(value).alias("value")))

    headers = F.array_compact(
        F.array(
            header(url.like("http://%"), "Server", "nginx/1.2"),
            header(url.like("%.org/%"), "X-Frame-Options", "DENY"),
            header(F.lit(True), "Content-Type", "text/html; Charset=UTF-8"),
            header(url.like("%.net/%"), "X-Powered-By", "PHP/7.4"),
            header(url.like("https://m.%"), "strict-transport-security", "max-age=1"),
        )
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.concat("html", extra).alias("html"),
        F.map_from_entries(headers).alias("headers"),
        F.when(url.like("%spam-farm%"), F.lit("Timeout after 10s")).alias("fetch_error"),
    )


# --- the same views as SQL -------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_CVE = """cve AS (
  SELECT 'CVE-' || d.doc_id AS cve_id,
    CASE WHEN d.source = 'src7' THEN NULL ELSE ' ' || d.lang || '/' || d.source END AS cwe_name,
    CASE WHEN d.source = 'src13' THEN NULL ELSE d.text END AS summary
  FROM documents d)"""

SQL_DIMENSIONS = """products AS (
  SELECT 'CVE-' || l_orderkey AS cve_id,
    CASE WHEN l_quantity < 3 THEN NULL ELSE 'part-' || l_partkey END AS vulnerable_product
  FROM lineitem),
vendor_product AS (
  SELECT s_name AS vendor,
    'part-' || l_partkey || CASE WHEN p_size > 45 THEN ' v2' ELSE '' END AS product
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
vendors AS (
  SELECT s_name || CASE WHEN s_acctbal < 0 THEN ' (closed)' ELSE '' END AS vendor FROM supplier)"""

SQL_CORPUS = f"""WITH {SQL_CVE},
{SQL_DIMENSIONS},
corpus AS (
  SELECT c.cve_id, c.cwe_name, p.vulnerable_product, vp.vendor, c.summary,
    coalesce(c.summary, '') || ' ' || coalesce(p.vulnerable_product, '') || ' '
      || coalesce(vp.vendor, '') AS text
  FROM cve c LEFT JOIN products p ON p.cve_id = c.cve_id
  LEFT JOIN vendor_product vp ON vp.product = p.vulnerable_product
  LEFT JOIN vendors v ON v.vendor = vp.vendor
  WHERE c.cwe_name IS NOT NULL)"""

SQL_KEYED = f"""{SQL_CORPUS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY cve_id, vulnerable_product, vendor) - 1 AS copy_no
  FROM corpus),
keyed AS (
  SELECT *, cve_id || '|' || coalesce(vulnerable_product, '\\N') || '|' || coalesce(vendor, '\\N')
    || CASE WHEN copy_no > 0 THEN '|' || copy_no ELSE '' END AS row_key
  FROM numbered)"""


def sql_hash(key: str, seed: int | str = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT)"


SQL_LABELLED = (
    "labelled AS (SELECT doc_id, text, CASE WHEN doc_id = 3 THEN "
    + quote(RARE_CLASS)
    + " WHEN source IN ('src2', 'src5') THEN "
    + quote(MIXED_CLASS)
    + " ".join(f" WHEN lang = {quote(k)} THEN {quote(v)}" for k, v in CLASS_OF_LANG.items())
    + " END AS label FROM documents)"
)

SQL_PAGES = (
    "site AS (SELECT page_id, url, html || CASE "
    + " ".join(f"WHEN url LIKE {quote(k)} THEN {quote(v)}" for k, v in INJECTIONS)
    + """ ELSE '' END AS html,
  list_filter([
    CASE WHEN url LIKE 'http://%' THEN {'k': 'Server', 'v': 'nginx/1.2'} END,
    CASE WHEN url LIKE '%.org/%' THEN {'k': 'X-Frame-Options', 'v': 'DENY'} END,
    {'k': 'Content-Type', 'v': 'text/html; Charset=UTF-8'},
    CASE WHEN url LIKE '%.net/%' THEN {'k': 'X-Powered-By', 'v': 'PHP/7.4'} END,
    CASE WHEN url LIKE 'https://m.%' THEN {'k': 'strict-transport-security', 'v': 'max-age=1'} END
  ], lambda h: h IS NOT NULL) AS headers,
  CASE WHEN url LIKE '%spam-farm%' THEN 'Timeout after 10s' END AS fetch_error
  FROM pages)"""
)
