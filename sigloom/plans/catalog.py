"""Imports every query module so the catalogue is complete."""

from sigloom.plans import (  # noqa: F401
    chunk_queries,
    contract_queries,
    fitted_queries,
    gate_queries,
    metric_queries,
    model_queries,
    signal_queries,
    sweep_queries,
)
from sigloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
