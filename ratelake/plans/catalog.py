"""All registered queries; importing the modules registers them."""

from . import audit_queries, bill_queries, document_queries, estimate_queries, flag_queries, history_queries, model_queries, parsing_queries, provenance_queries, report_queries, status_queries, timeline_queries, usage_queries
from .registry import ORACLE_SQL, QUERIES

MODULES = (usage_queries, history_queries, document_queries, audit_queries, bill_queries, parsing_queries, status_queries, report_queries, estimate_queries, timeline_queries, model_queries, flag_queries, provenance_queries)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
