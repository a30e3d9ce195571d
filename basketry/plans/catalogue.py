"""The queries over the star schema and their SQL, put together from the modules of queries."""

from __future__ import annotations

from basketry.plans import checks, comparison, domain, governed, indices, models, publishing, reading, real_terms, screening, seasons, structure, uncertainty

MODULES = (indices, screening, domain, models, seasons, governed, structure, uncertainty, checks, publishing, reading, real_terms, comparison)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
