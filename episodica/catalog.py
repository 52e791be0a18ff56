"""Registry of the queries over the reference's own operators, and their SQL."""

from __future__ import annotations

FLAGSHIP = "intrinsic_guard"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def put(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from . import plans  # noqa: F401  registers on import


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
