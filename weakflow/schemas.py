"""Explicit input schemas, so that no scan spends a pass on type inference."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CVE = T.StructType(
    [
        T.StructField("cve_id", T.StringType()),
        T.StructField("mod_date", T.TimestampType()),
        T.StructField("pub_date", T.TimestampType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("cwe_code", T.IntegerType()),
        *_strings(
            "cwe_name",
            "summary",
            "access_authentication",
            "access_complexity",
            "access_vector",
            "impact_availability",
            "impact_confidentiality",
            "impact_integrity",
        ),
    ]
)
PRODUCTS = T.StructType(_strings("cve_id", "vulnerable_product"))
VENDOR_PRODUCT = T.StructType(_strings("vendor", "product"))
VENDORS = T.StructType(_strings("vendor"))
PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        *_strings("url", "html"),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        *_strings("fetch_error"),
    ]
)
# The eight page features, in the order in which they are joined into text.
FEATURES = (
    "url_analysis",
    "headers",
    "content",
    "technologies",
    "forms",
    "links",
    "errors",
    "security_headers",
)
