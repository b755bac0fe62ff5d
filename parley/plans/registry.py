"""The queries of the engagement engine by name, and their SQL."""

from __future__ import annotations

from . import made_session, session_queries

QUERIES = session_queries.QUERIES | made_session.QUERIES
ORACLE = session_queries.ORACLE | made_session.ORACLE
FLAGSHIP = "engagement_results"
