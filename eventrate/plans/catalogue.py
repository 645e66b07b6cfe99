"""All catalogue queries; importing the families registers them."""

from __future__ import annotations

from eventrate.plans import (  # noqa: F401
    level_queries,
    model_queries,
    numeric_queries,
    prepare_queries,
    score_queries,
)
from eventrate.plans.registry import CATALOGUE

__all__ = ["CATALOGUE"]
