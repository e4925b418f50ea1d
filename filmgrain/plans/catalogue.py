"""All registered queries."""

from filmgrain.plans import (  # noqa: F401
    activity, control, documents, editing, measured, moving, picture, reporting, streams,
)
from filmgrain.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
