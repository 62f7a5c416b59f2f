"""The catalogue of queries by name, and the SQL of those that SQL can express."""

from quern.plans import approximate, chunks, indexed, library, more, search, segmented

_PARTS = (search, library, chunks, more, segmented, approximate, indexed)


def queries():
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
