"""What can go wrong before a Spark job starts."""


class QueryError(ValueError):
    """A text is not a query of the dialect."""


class UnsupportedError(QueryError):
    """A query asks for what the dialect does not have."""


class CatalogError(QueryError):
    """A table is not mapped, or its files are not there."""
