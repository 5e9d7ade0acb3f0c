"""The registered queries, each with an equivalent SQL statement where one exists."""

from quernstone.plans import (  # noqa: F401
    activity,
    aggregates,
    events,
    joins,
    scalars,
    sinks,
    streams,
    udfs,
)
from quernstone.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
