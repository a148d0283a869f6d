"""Registered queries with their oracle SQL, one module per area."""

from importlib import import_module

MODULES = ("charts", "layers", "goldtables", "governed", "operations")


def all_registries():
    return [import_module(f"queries.{m}").R for m in MODULES]
