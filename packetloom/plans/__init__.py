"""Registered queries; importing the package fills the registry."""

from packetloom.plans import (  # noqa: F401
    data_queries,
    feature_queries,
    ml_queries,
    model_queries,
    text_queries,
)
from packetloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
