"""The operators applied to the star-schema tables, each with the SQL that gives the same rows where SQL can."""

from fieldbook.queries import aggs, joins, ledger, market, models, payloads, quality, reports, scalars, streams, windows
from fieldbook.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggs", "joins", "ledger", "market", "models", "payloads", "quality", "reports", "scalars", "streams", "windows"]
