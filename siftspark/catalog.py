"""All queries of the retrieval engine and their SQL, by name."""

from __future__ import annotations

from siftspark.plans import judging, layouts, records, streams, structure
from siftspark.plans.queries import oracle_sql, queries

__all__ = ["judging", "layouts", "oracle_sql", "queries", "records", "streams", "structure"]
