"""Feature text, risk levels and recommendations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weakflow.functions.text import contains_any, present
from weakflow.schemas import FEATURES

# Words in the feature text, and the phrase that they add.
KEYWORD_PHRASES = (
    (("sql", "database", "mysql", "error"), "database injection vulnerability"),
    (("script", "javascript", "xss"), "cross site scripting vulnerability"),
    (("upload", "file", "path"), "file inclusion vulnerability"),
    (("admin", "login", "authentication"), "authentication bypass vulnerability"),
)

# Advice for every page.
ADVICE_SECURITY_HEADERS = "Implement security headers (X-Frame-Options, CSP, HSTS)"
ADVICE_SERVER = "Consider hiding server version information"
ADVICE_FORMS = "Ensure all forms use HTTPS and proper validation"

# Words in the predicted label, and the advice that they add.
LABEL_ADVICE = (
    (
        ("injection", "sql"),
        (
            "Use parameterized queries to prevent SQL injection",
            "Implement input validation and sanitization",
            "Use ORM frameworks with built-in protection",
        ),
    ),
    (
        ("xss", "scripting"),
        (
            "Implement Content Security Policy (CSP)",
            "Sanitize all user inputs before output",
            "Use HTTPOnly and Secure flags for cookies",
        ),
    ),
    (
        ("authentication", "access"),
        (
            "Implement multi-factor authentication",
            "Use strong password policies",
            "Implement proper session management",
        ),
    ),
    (
        ("buffer", "overflow"),
        (
            "Implement proper input length validation",
            "Use safe string handling functions",
            "Enable compiler-based buffer overflow protections",
        ),
    ),
)
# Fixed value: at most so many recommendations are given.
MAX_ADVICE = 5

# Upper confidence bounds of the risk levels, and the level above them.
RISK_BOUNDS = ((0.3, "LOW"), (0.6, "MEDIUM"), (0.8, "HIGH"))
# The highest level, and the colour of each level.
RISK_TOP = "CRITICAL"
RISK_COLOURS = {"LOW": "green", "MEDIUM": "orange", "HIGH": "red"}
RISK_TOP_COLOUR = "darkred"


def named_features(features: tuple[str, ...] = FEATURES) -> Column:
    """The non-empty features, each after its name."""
    parts = [(F.col(f) != "", F.concat(F.lit(f + " "), F.col(f))) for f in features]
    return F.array_join(present(*parts), " ")


def with_keywords(text: Column) -> Column:
    lowered = F.lower(text)
    phrases = present(*[(contains_any(lowered, w), F.lit(p)) for w, p in KEYWORD_PHRASES])
    return F.array_join(F.concat(F.array(text), phrases), " ")


def risk_level(confidence: Column) -> Column:
    (first, level), *rest = RISK_BOUNDS
    out = F.when(confidence < first, level)
    for bound, level in rest:
        out = out.when(confidence < bound, level)
    return out.otherwise(RISK_TOP)


def risk_colour(level: Column) -> Column:
    out = F.lit(RISK_TOP_COLOUR)
    for name, colour in RISK_COLOURS.items():
        out = F.when(level == name, colour).otherwise(out)
    return out


def recommendations(
    security_headers: Column, headers: Column, forms: Column, label: Column
) -> Column:
    """The first five pieces of advice that apply."""
    lowered = F.lower(label)
    rules = [
        (security_headers == "", (ADVICE_SECURITY_HEADERS,)),
        (F.contains(F.lower(headers), F.lit("server")), (ADVICE_SERVER,)),
        (F.contains(F.lower(forms), F.lit("form")), (ADVICE_FORMS,)),
        *[(contains_any(lowered, words), texts) for words, texts in LABEL_ADVICE],
    ]
    groups = present(*[(cond, F.array(*[F.lit(t) for t in texts])) for cond, texts in rules])
    return F.slice(F.flatten(groups), 1, MAX_ADVICE)
