"""All registered queries."""

from weakflow.plans import artefact_queries, classify_queries, corpus_queries, page_queries
from weakflow.plans.registry import Query

_REGISTRIES = (
    corpus_queries.registry,
    page_queries.registry,
    classify_queries.registry,
    artefact_queries.registry,
)


def queries() -> dict[str, Query]:
    return {name: q for r in _REGISTRIES for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _REGISTRIES for name, sql in r.oracles.items()}
