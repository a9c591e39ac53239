"""All queries of the library, and the SQL that says the same."""

from __future__ import annotations

from .operators import catalogue, interfaces, passthrough, roundtrips
from .quality import queries as quality

QUERIES = {**catalogue.QUERIES, **passthrough.QUERIES, **roundtrips.QUERIES, **interfaces.QUERIES, **quality.QUERIES}
ORACLES = {**catalogue.ORACLES, **passthrough.ORACLES, **roundtrips.ORACLES, **interfaces.ORACLES, **quality.ORACLES}
