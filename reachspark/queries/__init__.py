"""Registered queries over the driver tables, each with an SQL text that checks it where SQL can."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401
    q_algebra,
    q_cells,
    q_flow,
    q_plans,
    q_regions,
    q_sources,
)
