"""URL expressions (RFC 3986 splitting, as the page reports need it)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    """The path, without ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def with_scheme(url: Column) -> Column:
    """Add ``https://`` unless the URL already is http or https."""
    known = url.startswith("http://") | url.startswith("https://")
    return F.when(known, url).otherwise(F.concat(F.lit("https://"), url))


def domain_key(url: Column) -> Column:
    """Network location usable as a file or partition name."""
    return F.translate(netloc(url), ".:", "__")


def url_analysis(url: Column) -> Column:
    return F.concat(
        F.lit("domain "), netloc(url), F.lit(" path "), path(url), F.lit(" query "), query(url)
    )
