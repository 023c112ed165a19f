"""Query name to Spark callable, and query name to checking SQL."""

from importlib import import_module

MODULES = ["conversation", "edits", "catalog", "events", "voices", "files", "streams", "process"]


def load():
    queries, oracle = {}, {}
    for name in MODULES:
        module = import_module(f"parley.registry.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
