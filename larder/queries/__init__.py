"""Registered queries: every operator run over the given tables, with SQL that must give the same rows."""

from larder.queries import (  # noqa: F401
    aggregates,
    domain,
    filters,
    joins,
    models,
    scalars,
    schema,
    sorting,
    sources,
    windows,
)
from larder.queries.registry import ORACLES, QUERIES  # noqa: F401
