"""Imports every module that registers queries."""

from cadenza.plans import q_aggregates, q_corpus, q_functions, q_joins, q_jobs, q_signal, q_sources, q_windows  # noqa: F401
from cadenza.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
