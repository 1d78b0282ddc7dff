"""Registered queries and their oracles."""

from tracewright.plans import activity, catalog, report, segmentation, storage, texts

QUERIES = segmentation.QUERIES | activity.QUERIES | texts.QUERIES | catalog.QUERIES | report.QUERIES | storage.QUERIES
ORACLE_SQL = segmentation.ORACLE_SQL | activity.ORACLE_SQL | texts.ORACLE_SQL | catalog.ORACLE_SQL | report.ORACLE_SQL | storage.ORACLE_SQL
FLAGSHIP = "step_sentences"
