"""All queries of the library (but those of its optional subpackage), by name."""

from __future__ import annotations

from . import q_diagnose, q_evaluate, q_features, q_prepare, q_relevance, q_validate

_MODULES = (q_features, q_prepare, q_evaluate, q_diagnose, q_relevance, q_validate)


def queries():
    return {k: v[0] for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v[1] for m in _MODULES for k, v in m.QUERIES.items() if v[1]}
