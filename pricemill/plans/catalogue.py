"""Queries of the core and their SQL."""

from . import board_queries, file_queries, offer_queries, problems

_MODULES = (offer_queries, board_queries, file_queries, problems)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
