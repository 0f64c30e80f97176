"""The engine's registered queries, and their SQL where DuckDB can express them."""

from . import agent, evaluation, graph, memory, output, retrieval, text

_PARTS = (text, retrieval, graph, memory, agent, evaluation, output)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
