"""Query catalogue over the driver tables, one module per operator family."""

from importlib import import_module

FAMILIES = ("shaping", "filtering", "sampling", "joining", "tasks", "inout", "rules")


def load():
    from pairmill.catalog import base

    for f in FAMILIES:
        import_module(f"pairmill.catalog.{f}")
    return base.QUERIES, base.ORACLE
