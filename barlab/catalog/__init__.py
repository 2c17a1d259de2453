"""Registered queries over the driver tables, each with its SQL twin."""

from __future__ import annotations


def load_catalog():
    """Import every query module and return (queries, SQL twins)."""
    from barlab.catalog import (  # noqa: F401
        feature_queries,
        log_queries,
        market_queries,
        metric_queries,
        model_queries,
        plan_queries,
    )
    from barlab.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
