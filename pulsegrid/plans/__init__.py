"""Named queries and the SQL that they must agree with."""


def all_queries():
    """Every named query of the library and the SQL of those that have one."""
    from pulsegrid.plans import books, daily, events, evidence, exchange, form, other, scalars, upkeep  # noqa: F401  they register their queries
    from pulsegrid.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
