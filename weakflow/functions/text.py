"""Text and array expressions. All are built-in Spark functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words (the apostrophe is kept).
WORD_SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
_BETWEEN_WORDS = "[ " + "".join("\\" + c for c in WORD_SEPARATORS) + "]+"


def split_words(text: Column) -> Column:
    """What stands between runs of separators and spaces, lower-cased; the first and last may be empty."""
    return F.split(F.lower(text), _BETWEEN_WORDS)


def tokenize(text: Column) -> Column:
    """Lower-cased words; empty words are dropped."""
    return F.array_remove(split_words(text), "")


def pad_post(ids: Column, length: int = 300) -> Column:
    """The first ``length`` ids, filled up with zeros at the end."""
    head = F.slice(ids, 1, length)
    return F.concat(head, F.array_repeat(F.lit(0), F.lit(length) - F.size(head)))


def one_hot(y: Column, k: Column | int) -> Column:
    last = (k if isinstance(k, Column) else F.lit(k)) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.when(i == y, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"),
    )


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Bare substring tests, without word boundaries."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def matches(text: Column, pattern: str) -> Column:
    """Regex search in which ``.`` stops at ``\\n`` only."""
    return text.rlike("(?d)" + pattern)


def present(*items: tuple[Column, Column]) -> Column:
    """Ordered list of the values whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in items]))


def preview(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def timestamp_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def fixed_decimals(x: Column, places: int) -> Column:
    """Text of a non-negative number with ``places`` decimals, rounding half up."""
    return F.format_string(f"%.{places}f", x)


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)
