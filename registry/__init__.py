"""The queries run by the driver, each next to the SQL that states its result."""

from importlib import import_module

from registry.common import QUERIES, SQL

MODULES = ("rules", "columns", "rows", "numbers", "dates", "texts", "logic", "reports", "runs", "files")


def _load() -> None:
    for module in MODULES:
        import_module(f"registry.{module}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
