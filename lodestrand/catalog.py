"""All queries of the core with their SQL."""

from __future__ import annotations

from .plans import facts, models, quality, rankings, screening

QUERIES: dict = facts.QUERIES | models.QUERIES | rankings.QUERIES | quality.QUERIES | screening.QUERIES
SQL: dict = facts.SQL | models.SQL | rankings.SQL | quality.SQL | screening.SQL
