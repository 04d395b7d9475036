"""Named queries over the driver's tables, each with its SQL twin."""

from millrace.plans import dataflows, registry, relational, versioned


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


__all__ = ["dataflows", "oracle_sql", "queries", "registry", "relational", "versioned"]
