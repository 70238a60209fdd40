"""All registered queries.  Importing a family module fills the registry."""

from gridscan.queries import (  # noqa: F401
    aggregating, arriving, cascading, checking, evaluating, featuring, filtering, grids, joining, labelling, sampling, scalars,
    stencils, storing,
)
from gridscan.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
