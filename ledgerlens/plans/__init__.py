"""Registered queries with their SQL counterparts."""

from ledgerlens.plans import flows, learning, live, monitoring, scoring, training  # noqa: F401
from ledgerlens.plans.base import ORACLES, QUERIES  # noqa: F401
