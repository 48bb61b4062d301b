"""Registered queries over the tables and their SQL."""

from critiq.plans import catalog, files, reviews, scoring

QUERIES = {**catalog.QUERIES, **reviews.QUERIES, **scoring.QUERIES, **files.QUERIES}
ORACLES = {**catalog.ORACLES, **reviews.ORACLES, **scoring.ORACLES, **files.ORACLES}
