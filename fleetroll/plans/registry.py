"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and the SQL with the same result."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    import importlib
    import pkgutil

    from fleetroll import plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        if m.startswith("q_"):
            importlib.import_module(f"fleetroll.plans.{m}")

