"""Queries over the test tables, with their SQL."""

from loomgrain.queries import compaction, curation, loop, monitors, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in (compaction, texts, curation, loop, monitors):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
