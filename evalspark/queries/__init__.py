"""Registered queries over the given tables, with equivalent SQL where there is one."""

from evalspark.queries import profile, records

MODULES = (records, profile)


def all_queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
