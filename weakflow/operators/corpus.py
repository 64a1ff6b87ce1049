"""Assembly of the labelled text corpus from the CVE, product and vendor tables.

The reading order of the joins is CVE -> products -> vendor_product -> vendors. The
left joins are regrouped as CVE -> (products -> vendor_product -> vendors), which gives
the same rows: the narrow key tables fan out first, and the wide summaries are shuffled
once, before the fan-out. Exact copies of a row travel as one row with a count.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.operators.joins import (
    BROADCAST_BYTES,
    HOT_ROWS,
    broadcast_if_small,
    is_small,
    key_sizes,
    spread_left_join,
)
from weakflow.sources.staging import stage

# The column names of the CVE table.
CVE_COLUMNS = [
    "cve_id",
    "mod_date",
    "pub_date",
    "cvss",
    "cwe_code",
    "cwe_name",
    "summary",
    "access_authentication",
    "access_complexity",
    "access_vector",
    "impact_availability",
    "impact_confidentiality",
    "impact_integrity",
]
_CHUNK = 10_000
NULL_MARK = "\\N"  # stands for NULL in a row key, so that it differs from an empty name


def project_cve(cve: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return cve.select(*(columns or CVE_COLUMNS))


def corpus_text() -> Column:
    """Summary, product and vendor joined by single spaces; missing parts are empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("summary", "vulnerable_product", "vendor")]
    return F.concat_ws(" ", *parts)


def text_length() -> Column:
    """Characters of ``corpus_text``, from those of its parts: a summary's are counted once per CVE."""
    names = [F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("vulnerable_product", "vendor")]
    return F.col("summary_length") + names[0] + names[1] + 2


def row_key() -> Column:
    """Identifies a corpus row: CVE, product and vendor, and a number for exact copies. Where
    several CVE rows share an id, their rows share keys, and samplers take or leave them together."""
    parts = [F.coalesce(F.col(c), F.lit(NULL_MARK)) for c in ("cve_id", "vulnerable_product", "vendor")]
    copy = F.when(F.col("copy_no") > 0, F.concat(F.lit("|"), F.col("copy_no").cast("string")))
    return F.concat(F.concat_ws("|", *parts), F.coalesce(copy, F.lit("")))


def join_products(cve: DataFrame, products: DataFrame) -> DataFrame:
    """CVE left join products on the CVE id (1:N)."""
    return spread_left_join(cve, products, "cve_id")


def join_vendor_products(rows: DataFrame, vendor_product: DataFrame) -> DataFrame:
    """Left join on the product name alone (N:M); both name columns are kept."""
    keyed = vendor_product.withColumn("_product", F.col("product"))
    left = rows.withColumn("_product", F.col("vulnerable_product"))
    return spread_left_join(left, keyed, "_product").drop("_product")


def count_copies(rows: DataFrame, name: str) -> DataFrame:
    """The distinct rows, each with the number of its exact copies."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(name))


def joined_copies(left: str, right: str) -> Column:
    """Rows that a left join of two tables has for a row of their distinct rows' left join."""
    return F.col(left) * F.coalesce(F.col(right), F.lit(1))


def join_vendors(
    rows: DataFrame,
    vendors: DataFrame,
    unique: bool = False,
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join on the key-only vendor table.

    It adds no column, only copies where a vendor is listed twice, so with ``unique``
    it is left out. The vendor column comes first. A vendor table that is not small is joined by a
    shuffle in which hot vendors are split and rows without a vendor take no part.
    """
    others = [c for c in rows.columns if c != "vendor"]
    if unique:
        return rows.select("vendor", *others)
    if is_small(vendors, max_bytes):
        joined = rows.join(F.broadcast(vendors), "vendor", "left")
    else:
        joined = spread_left_join(rows, vendors, "vendor", hot_rows=hot_rows)
    return joined.select("vendor", *others)


def _vendor_links(
    vendor_product: DataFrame,
    vendors: DataFrame,
    unique_vendors: bool,
    max_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(product, vendor, copies) with one row per pair."""
    pairs = vendor_product.groupBy("product", "vendor").agg(F.count(F.lit(1)).alias("copies"))
    if unique_vendors:
        return pairs
    listed = vendors.groupBy("vendor").agg(F.count(F.lit(1)).alias("_listed"))
    if is_small(listed, max_bytes):
        counted = pairs.join(F.broadcast(listed), "vendor", "left")
    else:
        pairs = stage(pairs, "vendor-pairs")
        counted = spread_left_join(pairs, listed, "vendor", right_unique=True, hot_rows=hot_rows)
    return counted.select(
        "product", "vendor", (F.col("copies") * F.coalesce("_listed", F.lit(1))).alias("copies")
    )


def _named_products(products: DataFrame, cve_ids: DataFrame) -> DataFrame:
    """(cve_id, _product, pcopies) of the wanted CVEs, one row per pair. Products of other CVEs are
    left out before the pairs are counted and shuffled."""
    wanted = products.join(broadcast_if_small(cve_ids.select("cve_id")), "cve_id", "left_semi")
    return wanted.groupBy("cve_id", F.col("vulnerable_product").alias("_product")).agg(F.count(F.lit(1)).alias("pcopies"))


class Corpus:
    """The joined corpus of one set of input tables, in the forms that jobs need.

    The narrow tables below are stored on first use and shared by all methods. Several CVE rows
    may share an id, and an id may be NULL: each row keeps its own text, told apart by a mark
    of its content. ``unique_vendors`` says that no vendor is listed twice, which saves the
    join with the vendor table.
    """

    def __init__(
        self,
        cve: DataFrame,
        products: DataFrame,
        vendor_product: DataFrame,
        vendors: DataFrame,
        unique_vendors: bool = False,
        hot_rows: int = HOT_ROWS,
    ) -> None:
        self.cve = cve
        mark = F.xxhash64("cve_id", "cwe_name", "summary")
        self.labelled = cve.filter(F.col("cwe_name").isNotNull()).withColumn("cve_mark", mark)
        self.products = products
        self.vendor_product = vendor_product
        self.vendors = vendors
        self.unique_vendors = unique_vendors
        self.hot_rows = hot_rows

    @cached_property
    def named(self) -> DataFrame:
        """(cve_id, _product, pcopies) of the labelled CVEs, one row per pair."""
        return stage(_named_products(self.products, self.labelled), "cve-products")

    @cached_property
    def pairs(self) -> DataFrame:
        """(product, vendor, copies) of the products that labelled CVEs name, one row per pair. Other
        products join with nothing, so they are left out before the pairs are counted and shuffled."""
        wanted = self.product_sizes.select(F.col("_product").alias("product"))
        links = _vendor_links(
            self.vendor_product.join(broadcast_if_small(wanted), "product", "left_semi"),
            self.vendors,
            self.unique_vendors,
            hot_rows=self.hot_rows,
        )
        return stage(links, "product-vendors")

    @cached_property
    def product_sizes(self) -> DataFrame:
        """(_product, n): CVEs that name each product."""
        return stage(key_sizes(self.named, "_product"), "product-sizes")

    @cached_property
    def vendor_sizes(self) -> DataFrame:
        """(_product, n, vendors): pairs of each product, and the rows that a mention of it has."""
        sizes = self.pairs.groupBy(F.col("product").alias("_product")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("copies").alias("vendors")
        )
        return stage(sizes, "vendor-sizes")

    @cached_property
    def cve_sizes(self) -> DataFrame:
        """(cve_id, n): rows of each CVE's fan-out, counted without producing it."""
        return stage(self._sizes(), "cve-sizes")

    def links(self) -> DataFrame:
        """(cve_id, vulnerable_product, product, vendor, piece, copies): the fan-out without
        any text. A row stands for at most 10,000 exact copies."""
        right = self.pairs.withColumn("_product", F.col("product"))
        joined = spread_left_join(
            self.named,
            right,
            "_product",
            left_sizes=self.product_sizes,
            right_sizes=self.vendor_sizes,
            hot_rows=self.hot_rows,
        )
        total = F.col("pcopies") * F.coalesce("copies", F.lit(1))
        pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_total") - 1) / _CHUNK))
        return (
            joined.withColumn("_total", total)
            .withColumn("piece", F.explode(pieces))
            .select(
                "cve_id",
                F.col("_product").alias("vulnerable_product"),
                "product",
                "vendor",
                "piece",
                F.least(F.lit(_CHUNK), F.col("_total") - F.col("piece") * _CHUNK).alias("copies"),
            )
        )

    def _sizes(self) -> DataFrame:
        sized = spread_left_join(
            self.named,
            self.vendor_sizes.select("_product", F.col("vendors").alias("_vendors")),
            "_product",
            left_sizes=self.product_sizes,
            right_unique=True,
            hot_rows=self.hot_rows,
        )
        n = F.col("pcopies") * F.coalesce("_vendors", F.lit(1))
        return sized.groupBy("cve_id").agg(F.sum(n).alias("n"))

    def _fan_out(self, cve: DataFrame) -> DataFrame:
        """Each CVE with each of its links, exact copies expanded and numbered (``copy_no``)."""
        rows = spread_left_join(
            cve, self.links(), "cve_id", right_sizes=self.cve_sizes, hot_rows=self.hot_rows
        )
        filled = rows.withColumn("copies", F.coalesce("copies", F.lit(1))).withColumn(
            "piece", F.coalesce("piece", F.lit(0))
        )
        # A link stands for at most _CHUNK copies, so one short array numbers them.
        numbers = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
        numbered = filled.withColumn("_in_piece", F.explode(numbers)).drop("copies")
        return numbered.withColumn("copy_no", F.col("piece") * _CHUNK + F.col("_in_piece")).drop(
            "piece", "_in_piece"
        )

    def rows(self, drop_blank: bool = False) -> DataFrame:
        """The whole corpus: one row per CVE, product and vendor, with its text, the characters of the
        text (``text_length``) and the label.

        What depends on a summary alone is found once per CVE, before the fan-out. A job that reads no
        text carries none through the joins.
        """
        summary = F.coalesce(F.col("summary"), F.lit(""))
        sized = self.labelled.withColumns(
            {"summary_length": F.length(summary), "_summary_blank": F.trim(summary) == ""}
        )
        rows = self._fan_out(sized).withColumns({"text": corpus_text(), "text_length": text_length()})
        if drop_blank:  # a text is blank if its parts are
            named = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("vulnerable_product", "vendor")]
            rows = rows.filter(~F.col("_summary_blank") | named[0] | named[1])
        return rows.drop("summary_length", "_summary_blank")

    def keys(self) -> DataFrame:
        """The corpus rows without summaries: what counting and sampling need."""
        return self._fan_out(self.labelled.select("cve_id", "cwe_name", "cve_mark"))

    def attach_text(self, sample: DataFrame) -> DataFrame:
        """Text of a stored sample of ``keys``: one row per row of the sample.

        The texts of the sampled CVEs are looked up by id, label and the mark of their content, so
        a mark has to tell apart only the rows of one id. A small sample is broadcast to the CVE
        scan, so the wide table is not shuffled at all.
        """
        identity = ["cve_id", "cwe_name", "cve_mark"]
        renamed = [F.col(c).alias(f"_{c}") for c in identity]
        wanted = sample.select(*renamed).distinct()
        texts = self.labelled.select(*identity, "summary")
        known = texts.join(wanted, [texts[c].eqNullSafe(wanted[f"_{c}"]) for c in identity], "left_semi")
        once = known.dropDuplicates(identity).select(*renamed, "summary")
        same = [sample[c].eqNullSafe(once[f"_{c}"]) for c in identity]
        found = sample.join(once, same, "left").drop(*[f"_{c}" for c in identity])
        return found.withColumn("text", corpus_text())

    def label_counts(self, count_by: str = "row") -> DataFrame:
        """(cwe_name, n) over corpus rows, or over CVEs with ``count_by='cve'``."""
        labelled = self.labelled.select("cve_id", "cwe_name")
        if count_by == "cve":
            return labelled.groupBy("cwe_name").agg(F.count(F.lit(1)).alias("n"))
        sized = labelled.join(self.cve_sizes, "cve_id", "left")
        return sized.groupBy("cwe_name").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


def keep_labelled(rows: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Rows with a label and a text.

    The text always holds its two joining spaces, so ``text <> ''`` keeps every row;
    ``drop_blank`` also removes the texts that hold nothing else.
    """
    text = F.trim("text") if drop_blank else F.col("text")
    return rows.filter((text != "") & F.col("cwe_name").isNotNull())
