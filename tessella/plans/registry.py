"""Every registered query, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import beliefs, curation, dialogue, growth, layouts, problems, relations, sampling, scores, search, streams

_PARTS = (dialogue, scores, sampling, beliefs, search, relations, curation, problems, layouts, growth, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
