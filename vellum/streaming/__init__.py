"""The dialect over streams: filters and projections of a query run on any streaming DataFrame.

The same compiler serves, for a query without ORDER BY, LIMIT or DISTINCT compiles to stateless operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellum.engine import Engine
from vellum.errors import UnsupportedError
from vellum.plans import dialect


def sql(engine: Engine, text: str, **streams: DataFrame) -> DataFrame:
    """A query over streaming tables, given by name, and the engine's static ones."""
    query = dialect.parse(text)
    if query.order or query.limit is not None or query.distinct:
        raise UnsupportedError("ORDER BY, LIMIT and DISTINCT have no end on a stream")
    for name, df in streams.items():
        engine.catalog.register(name, df)
    return engine.sql(text)
