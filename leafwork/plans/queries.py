"""All queries of the core and their SQL."""

from __future__ import annotations

from leafwork.plans import general, layout, nested, pages

QUERIES = pages.QUERIES | layout.QUERIES | general.QUERIES | nested.QUERIES

SQL: dict[str, str] = pages.SQL | layout.SQL | general.SQL | nested.SQL
