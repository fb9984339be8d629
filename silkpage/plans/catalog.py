"""Every registered query of the web-capture side and its SQL."""

from __future__ import annotations

from silkpage.plans import html, pages, records, rules

QUERIES: dict = pages.QUERIES | html.QUERIES | rules.QUERIES | records.QUERIES
SQL: dict = pages.SQL | html.SQL | rules.SQL | records.SQL
