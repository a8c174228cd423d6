"""The queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from parcelry.plans import audits, files, looks, outcomes, resolution, reviews, scores  # noqa: F401
from parcelry.plans.registry import ORACLES, QUERIES


def entry(spark, folder):
    """Coverage of the opportunity by holders, in the current state and the new one."""
    return QUERIES["coverage_states"](spark, folder)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
