"""Named queries over the test tables, each with its SQL twin where one exists."""

from statloom.queries import charts, cleaning, describing, forecasting, learning, loading, neighbours, sampling, series, sketching, spectrum, streaming, text
from statloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "charts", "cleaning", "describing", "forecasting", "learning", "loading", "neighbours", "sampling", "series", "sketching", "spectrum", "streaming", "text"]
