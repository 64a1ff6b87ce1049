"""Queries over the corpus tables: sources, joins, counts, samples and splits."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakflow import schemas
from weakflow.functions.text import WORD_SEPARATORS, timestamp_stamp, timestamp_text, tokenize
from weakflow.operators import corpus, labels, observed, sampling
from weakflow.plans import fixtures as fx
from weakflow.plans.registry import Registry
from weakflow.sources import artefacts, tables
from weakflow.sources.staging import new_path, stage

registry = Registry()
KEYS = ["cve_id", "vulnerable_product", "vendor", "cwe_name"]


def _corpus(spark: SparkSession, sf_dir: str) -> corpus.Corpus:
    return corpus.Corpus(*fx.corpus_tables(spark, sf_dir))


def _rounded(x: Column, places: int = 6) -> Column:
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def _with_digest(df: DataFrame) -> DataFrame:
    length = F.col("text_length") if "text_length" in df.columns else F.length("text")
    return df.select(*KEYS, F.md5("text").alias("text_md5"), length.alias("text_length"))


@registry.add(
    "scan_csv_roundtrip",
    f"""WITH {fx.SQL_DIMENSIONS}
SELECT cve_id, vulnerable_product, count(*) AS n FROM products GROUP BY ALL""",
)
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "products-csv")
    tables.write_csv(fx.products(spark, sf_dir), path)
    df = tables.read_csv(spark, path, schemas.PRODUCTS)
    return df.groupBy("cve_id", "vulnerable_product").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "header_repair",
    f"WITH {fx.SQL_CVE} SELECT cve_id, cwe_name FROM cve",
)
def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = fx.cve(spark, sf_dir).select(F.col("cve_id").alias("_c0"), "cwe_name", "summary")
    return tables.repair_header(blank).select("cve_id", "cwe_name")


@registry.add(
    "profile_columns",
    f"""WITH {fx.SQL_CVE}
SELECT CAST(0 AS INT) AS position, 'cve_id' AS column_name, 'string' AS column_type,
  count(*) AS n_rows, count(cve_id) AS n_values FROM cve
UNION ALL SELECT 1, 'cwe_name', 'string', count(*), count(cwe_name) FROM cve
UNION ALL SELECT 2, 'summary', 'string', count(*), count(summary) FROM cve""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile_columns(fx.cve(spark, sf_dir))


@registry.add(
    "cve_project",
    """SELECT 'CVE-' || doc_id AS cve_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS mod_date,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS pub_date, o_totalprice AS cvss,
  CAST(n_chars AS INT) AS cwe_code,
  CASE WHEN source = 'src7' THEN NULL ELSE ' ' || lang || '/' || source END AS cwe_name,
  md5(text) AS summary, lang AS access_authentication, o_orderpriority AS access_complexity,
  source AS access_vector, o_orderstatus AS impact_availability,
  o_orderstatus AS impact_confidentiality, o_orderstatus AS impact_integrity
FROM documents LEFT JOIN orders ON o_orderkey = doc_id""",
)
def cve_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus.project_cve(fx.cve_full(spark, sf_dir))
    return df.withColumns(
        {
            "mod_date": timestamp_text(F.col("mod_date")),
            "pub_date": timestamp_text(F.col("pub_date")),
            "summary": F.md5("summary"),
        }
    )


@registry.add(
    "timestamp_format",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts_text,
  strftime(o_orderdate, '%Y%m%d_%H%M%S') AS ts_stamp FROM orders""",
)
def timestamp_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", timestamp_text(ts).alias("ts_text"), timestamp_stamp(ts).alias("ts_stamp")
    )


@registry.add(
    "join_cve_products",
    f"""WITH {fx.SQL_CVE}, {fx.SQL_DIMENSIONS}
SELECT c.cve_id, c.cwe_name, p.vulnerable_product
FROM cve c LEFT JOIN products p ON p.cve_id = c.cve_id""",
)
def join_cve_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    cve = fx.cve(spark, sf_dir).select("cve_id", "cwe_name")
    return corpus.join_products(cve, fx.products(spark, sf_dir))


@registry.add(
    "join_product_vendor",
    f"""WITH {fx.SQL_DIMENSIONS}
SELECT p.cve_id, p.vulnerable_product, vp.product, vp.vendor, count(*) AS n
FROM products p LEFT JOIN vendor_product vp ON vp.product = p.vulnerable_product GROUP BY ALL""",
)
def join_product_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Copies are counted before the join: its rows are then distinct, and no shuffle holds the fan-out.
    left = corpus.count_copies(fx.products(spark, sf_dir), "_left_copies")
    right = corpus.count_copies(fx.vendor_product(spark, sf_dir), "_right_copies")
    rows = corpus.join_vendor_products(left, right)
    return rows.select(
        "cve_id", "vulnerable_product", "product", "vendor", corpus.joined_copies("_left_copies", "_right_copies").alias("n")
    )


@registry.add(
    "join_vendors",
    f"""WITH {fx.SQL_DIMENSIONS}
SELECT vp.vendor, vp.product FROM vendor_product vp LEFT JOIN vendors v ON v.vendor = vp.vendor""",
)
def join_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.join_vendors(fx.vendor_product(spark, sf_dir), fx.vendors(spark, sf_dir))


@registry.add(
    "corpus_text",
    f"""{fx.SQL_CORPUS}
SELECT cve_id, vulnerable_product, vendor, cwe_name, md5(text) AS text_md5,
  length(text) AS text_length FROM corpus""",
)
def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_digest(_corpus(spark, sf_dir).rows())


@registry.add(
    "corpus_filter",
    f"""{fx.SQL_CORPUS}
SELECT cwe_name, count(*) AS n, sum(length(text)) AS text_length FROM corpus
WHERE trim(text) <> '' GROUP BY cwe_name""",
)
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).rows(drop_blank=True)
    return rows.groupBy("cwe_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_length").alias("text_length")
    )


def _combined(rows: DataFrame) -> DataFrame:
    """(cwe_name, cve_id, n, v, len, lo, hi): rows, rows with a vendor, characters, and the first and last
    digest, combined within each batch of rows.

    Spark keeps a running minimum of a string only in sorted groups, so it would sort the fan-out. The
    rows of a CVE lie together after the join, so a batch has few CVEs, and only their sums go on.
    """
    digests = rows.select(
        "cwe_name",
        "cve_id",
        F.col("vendor").isNotNull().cast("long").alias("v"),
        F.col("text_length").cast("long").alias("len"),
        F.md5("text").alias("digest"),
    )
    sums = [("len", "count"), ("v", "sum"), ("len", "sum"), ("digest", "min"), ("digest", "max")]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(["cwe_name", "cve_id"]).aggregate(sums)
            columns = ["cwe_name", "cve_id", *[f"{c}_{how}" for c, how in sums]]
            yield from found.select(columns).rename_columns(["cwe_name", "cve_id", "n", "v", "len", "lo", "hi"]).to_batches()

    return digests.mapInArrow(combine, "cwe_name string, cve_id string, n long, v long, len long, lo string, hi string")


@registry.add(
    "corpus_assemble",
    f"""{fx.SQL_CORPUS}
SELECT cwe_name, count(*) AS n_rows, count(DISTINCT cve_id) AS n_cves,
  count(vendor) AS n_vendor_rows, sum(length(text)) AS text_length,
  min(md5(text)) AS first_md5, max(md5(text)) AS last_md5
FROM corpus GROUP BY cwe_name""",
)
def corpus_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text rows per weakness class, from the whole corpus."""
    rows = _corpus(spark, sf_dir).rows()
    # Two levels: the first has one row per CVE, so no class is gathered to count its CVEs.
    per_cve = _combined(rows).groupBy("cwe_name", "cve_id").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("len").alias("len"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return per_cve.groupBy("cwe_name").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cves"),
        F.sum("v").alias("n_vendor_rows"),
        F.sum("len").alias("text_length"),
        F.min("lo").alias("first_md5"),
        F.max("hi").alias("last_md5"),
    )


@registry.add(
    "corpus_parquet_project",
    f"{fx.SQL_CORPUS} SELECT cwe_name, md5(text) AS text_md5 FROM corpus",
)
def corpus_parquet_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "corpus")
    rows = _corpus(spark, sf_dir).rows()
    # The rows of a CVE lie together after the join, and their texts begin with the same summary.
    tables.write_parquet(rows.select("text", "cwe_name"), path, shared_prefixes=True)
    stored = tables.read_parquet(spark, path, ["text", "cwe_name"])
    return stored.select("cwe_name", F.md5("text").alias("text_md5"))


@registry.add(
    "page_rows",
    f"""{fx.SQL_KEYED} SELECT row_key, cwe_name FROM keyed
ORDER BY row_key LIMIT 5000 OFFSET 5000""",
)
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).keys()
    keyed = rows.select(corpus.row_key().alias("row_key"), "cwe_name")
    return tables.page_rows(keyed, ["row_key"], 5000, 5000)


@registry.add(
    "page_after",
    f"""{fx.SQL_KEYED} SELECT row_key, cwe_name FROM keyed WHERE row_key > 'CVE-5'
ORDER BY row_key LIMIT 5000""",
)
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of rows that follows a key; its cost does not grow with the place of the page."""
    rows = _corpus(spark, sf_dir).keys()
    keyed = rows.select(corpus.row_key().alias("row_key"), "cwe_name")
    return tables.page_after(keyed, "row_key", "CVE-5", 5000)


@registry.add(
    "label_counts",
    f"{fx.SQL_CORPUS} SELECT cwe_name, count(*) AS n FROM corpus GROUP BY cwe_name",
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).label_counts()


_SQL_FRACTION = """CASE WHEN n < 1000 THEN least(CAST(3.0 AS DOUBLE) / n, CAST(0.01 AS DOUBLE))
  ELSE CAST(0.002 AS DOUBLE) END"""


@registry.add(
    "label_fractions",
    f"""{fx.SQL_CORPUS}, counts AS (SELECT cwe_name, count(*) AS n FROM corpus GROUP BY cwe_name)
SELECT cwe_name, n, floor({_SQL_FRACTION} * 1e6 + 0.5) / 1e6 AS fraction FROM counts""",
)
def label_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _corpus(spark, sf_dir).label_counts()
    return sampling.label_fractions(counts).withColumn("fraction", _rounded(F.col("fraction")))


@registry.add(
    "corpus_totals",
    f"""{fx.SQL_CORPUS}
SELECT (SELECT count(*) FROM corpus) AS n_rows,
  (SELECT count(DISTINCT cwe_name) FROM corpus) AS n_classes,
  (SELECT count(*) FROM cve) AS n_cves,
  (SELECT count(*) FROM cve WHERE cwe_name IS NULL) AS n_unlabelled""",
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cve = fx.cve(spark, sf_dir)
    counts = _corpus(spark, sf_dir).label_counts()
    totals = counts.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"))
    unlabelled = F.sum(F.when(F.col("cwe_name").isNull(), 1).otherwise(0).cast("long"))
    return totals.select(
        "n_rows",
        "n_classes",
        cve.agg(F.count(F.lit(1))).scalar().alias("n_cves"),
        cve.agg(unlabelled).scalar().alias("n_unlabelled"),
    )


@registry.add(
    "label_dictionary",
    f"""WITH {fx.SQL_CVE}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx
FROM (SELECT DISTINCT cwe_name AS label FROM cve WHERE cwe_name IS NOT NULL)""",
)
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_dictionary(fx.cve(spark, sf_dir), "cwe_name")


@registry.add(
    "label_dict_parse",
    f"""WITH {fx.SQL_CVE}
SELECT trim(label) AS label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx
FROM (SELECT DISTINCT cwe_name AS label FROM cve WHERE cwe_name IS NOT NULL)""",
)
def label_dict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "labels")
    artefacts.save_label_dictionary(labels.label_dictionary(fx.cve(spark, sf_dir), "cwe_name"), path)
    return artefacts.load_label_dictionary(spark, path)


@registry.add(
    "label_encode",
    f"""WITH {fx.SQL_CVE}, dict AS (
  SELECT cwe_name, CAST(row_number() OVER (ORDER BY cwe_name) - 1 AS INT) AS y
  FROM (SELECT DISTINCT cwe_name FROM cve WHERE cwe_name IS NOT NULL))
SELECT c.cve_id, c.cwe_name, d.y FROM cve c JOIN dict d ON d.cwe_name = c.cwe_name""",
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cve = fx.cve(spark, sf_dir).select("cve_id", "cwe_name")
    dictionary = stage(labels.label_dictionary(cve, "cwe_name"), "dictionary")
    return labels.label_encode(cve, dictionary, "cwe_name")


_SQL_FINE = """fine AS (
  SELECT d.doc_id, d.lang || '/' || d.source || '/' || coalesce('' || l.quality || l.toxic, '-')
    AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _fine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = docs.join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.concat_ws("/", "lang", "source", F.coalesce(marks, F.lit("-")))
    return joined.select("doc_id", label.alias("label"))


@registry.add(
    "rare_label_filter",
    f"""WITH {_SQL_FINE}, kept AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS y
  FROM (SELECT label FROM fine GROUP BY label HAVING count(*) >= 2))
SELECT f.doc_id, f.label, k.y FROM fine f JOIN kept k ON k.label = f.label""",
)
def rare_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = labels.drop_rare_labels(_fine_labels(spark, sf_dir), "label")
    return rows


@registry.add(
    "sample_hash",
    f"""{fx.SQL_KEYED} SELECT cve_id, vulnerable_product, vendor, cwe_name, copy_no FROM keyed
WHERE {fx.sql_hash("row_key")} < CAST(0.001 AS DOUBLE) * 4294967296.0""",
)
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).keys()
    return sampling.sample_rows(rows, corpus.row_key(), 0.001).select(*KEYS, "copy_no")


_SQL_STRATIFIED = f"""{fx.SQL_KEYED},
counts AS (SELECT cwe_name, count(*) AS n FROM corpus GROUP BY cwe_name),
shares AS (SELECT cwe_name, {_SQL_FRACTION} AS fraction FROM counts),
sampled AS (SELECT k.* FROM keyed k JOIN shares s ON s.cwe_name = k.cwe_name
  WHERE {fx.sql_hash("k.row_key")} < s.fraction * CAST(4294967296.0 AS DOUBLE))"""


def _stratified(source: corpus.Corpus) -> DataFrame:
    counts = stage(source.label_counts(), "label-counts")
    fractions = sampling.label_fractions(counts)
    return sampling.sample_stratified(source.keys(), fractions, corpus.row_key())


@registry.add(
    "sample_stratified",
    f"{_SQL_STRATIFIED} SELECT cve_id, vulnerable_product, vendor, cwe_name, copy_no FROM sampled",
)
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stratified(_corpus(spark, sf_dir)).select(*KEYS, "copy_no")


@registry.add(
    "sample_cap",
    f"""{fx.SQL_KEYED} SELECT cve_id, vulnerable_product, vendor, cwe_name, copy_no FROM keyed
ORDER BY {fx.sql_hash("row_key")}, row_key LIMIT 50000""",
)
def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_corpus(spark, sf_dir).keys(), "keys")
    return sampling.cap_rows(rows, 50_000, corpus.row_key()).select(*KEYS, "copy_no")


@registry.add(
    "training_set",
    f"""{_SQL_STRATIFIED}
SELECT cve_id, vulnerable_product, vendor, cwe_name, md5(text) AS text_md5,
  length(text) AS text_length FROM sampled
ORDER BY {fx.sql_hash("row_key")}, row_key LIMIT 200000""",
)
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified sample, capped, with text: summaries are read for sampled rows only."""
    source = _corpus(spark, sf_dir)
    sampled = stage(_stratified(source), "sample")
    capped = stage(sampling.cap_rows(sampled, 200_000, corpus.row_key()), "capped")
    return _with_digest(source.attach_text(capped))


_SPLIT = fx.sql_hash("row_key", "split")


@registry.add(
    "split_random",
    f"""{fx.SQL_KEYED} SELECT row_key, CASE WHEN {_SPLIT} < CAST(0.8 AS DOUBLE) * 4294967296.0
  THEN 'train' ELSE 'test' END AS part FROM keyed""",
)
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).keys()
    keyed = rows.select(corpus.row_key().alias("row_key"))
    return sampling.split_rows(keyed, F.col("row_key"))


@registry.add(
    "split_random_exact",
    f"""{fx.SQL_KEYED}, ranked AS (
  SELECT row_key, row_number() OVER (ORDER BY {_SPLIT}, row_key) AS r, count(*) OVER () AS n
  FROM keyed)
SELECT row_key, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part
FROM ranked""",
)
def split_random_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).keys()
    keyed = rows.select(corpus.row_key().alias("row_key"))
    return sampling.split_rows_exact(keyed, F.col("row_key"))


@registry.add(
    "split_stratified",
    f"""{fx.SQL_KEYED},
sizes AS (SELECT cwe_name, count(*) AS c FROM keyed GROUP BY cwe_name),
totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, (CAST(sum(c) AS BIGINT) * 20 + 99) // 100 AS nt
  FROM sizes),
shared AS (SELECT cwe_name, nt, (nt * c) // n AS base, (nt * c) % n AS rest FROM sizes, totals),
quotas AS (SELECT cwe_name, base + CASE WHEN
    row_number() OVER (ORDER BY rest DESC, cwe_name) <= nt - sum(base) OVER () THEN 1 ELSE 0 END
    AS quota FROM shared),
ranked AS (SELECT row_key, cwe_name,
    row_number() OVER (PARTITION BY cwe_name ORDER BY {_SPLIT}, row_key) AS r FROM keyed)
SELECT r.row_key, r.cwe_name, CASE WHEN r.r <= q.quota THEN 'test' ELSE 'train' END AS part
FROM ranked r JOIN quotas q ON q.cwe_name = r.cwe_name""",
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).keys()
    keyed = rows.select(corpus.row_key().alias("row_key"), "cwe_name")
    return sampling.split_stratified(keyed, F.col("row_key"), "cwe_name")


_MIN_OF_LABEL = 10


@registry.add(
    "corpus_drop_report",
    f"""WITH {fx.SQL_CVE},
judged AS (SELECT cwe_name, CASE WHEN cwe_name IS NULL THEN 'unlabelled'
    WHEN trim(coalesce(summary, '')) = '' THEN 'blank'
    WHEN trim(translate(summary, {fx.quote(WORD_SEPARATORS)}, '{" " * len(WORD_SEPARATORS)}')) = '' THEN 'empty'
    ELSE 'kept' END AS reason FROM cve),
sized AS (SELECT *, CASE WHEN reason = 'kept' AND count(*) FILTER (reason = 'kept') OVER (PARTITION BY cwe_name)
    < {_MIN_OF_LABEL} THEN 'rare' ELSE reason END AS final FROM judged)
SELECT r.reason, count(s.final) AS n FROM
  (SELECT unnest(['unlabelled', 'blank', 'empty', 'rare', 'kept']) AS reason) r
  LEFT JOIN sized s ON s.final = r.reason GROUP BY r.reason
UNION ALL SELECT 'rows', count(*) FROM sized""",
)
def corpus_drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the CVE table, and why the others are dropped, in one scan."""
    rows = fx.cve(spark, sf_dir)
    _, report = observed.drop_report(rows, "summary", "cwe_name", tokenize(F.col("summary")), _MIN_OF_LABEL)
    return report


@registry.add(
    "cap_repeated_keys",
    f"""WITH sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
placed AS (SELECT *, sum(n) OVER (ORDER BY {fx.sql_hash("source")}, source) - n AS before FROM sized)
SELECT source, CAST(least(n, 333 - before) AS BIGINT) AS n FROM placed WHERE before < 333""",
)
def cap_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap over rows whose key repeats gives exactly as many rows as asked for."""
    capped = sampling.cap_rows(fx.table(spark, sf_dir, "documents").select("source"), 333, F.col("source"))
    return capped.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "split_null_class",
    """WITH labelled AS (SELECT CASE WHEN lang <> 'en' THEN lang END AS label FROM documents),
sized AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS n_all, (CAST(sum(n) AS BIGINT) * 20 + 99) // 100 AS nt FROM sized),
shared AS (SELECT label, n, nt, (nt * n) // n_all AS base, (nt * n) % n_all AS rest FROM sized, totals),
quotas AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label NULLS FIRST)
  <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shared)
SELECT label, CAST(quota AS BIGINT) AS n_test, CAST(n - quota AS BIGINT) AS n_train FROM quotas""",
)
def split_null_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified split by a label that is NULL for a part of the rows, with keys that repeat."""
    label = F.when(F.col("lang") != "en", F.col("lang")).alias("label")
    rows = fx.table(spark, sf_dir, "documents").select("source", label)
    parts = sampling.split_stratified(rows, F.col("source"), "label")
    return parts.groupBy("label").agg(
        F.count_if(F.col("part") == "test").alias("n_test"), F.count_if(F.col("part") == "train").alias("n_train")
    )
