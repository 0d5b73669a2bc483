"""All registered queries and their SQL."""

from __future__ import annotations

from . import queries as _queries
from . import media as _media  # registers its queries
from . import scored as _scored
from ..streaming import queries as _streaming

QUERIES = _queries.QUERIES
SQL = _queries.SQL
__all__ = ["QUERIES", "SQL", "_media", "_scored", "_streaming"]
