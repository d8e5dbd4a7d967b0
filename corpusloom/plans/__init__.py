"""Queries over the driver's tables, one module per block of operators."""

from . import collection, corpus, evaluation, exchange, files, identity, integrity, ledger, retrieval, sessions, streams, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
