"""Importing this module registers every query."""

from demandgrid.plans import q_candidates, q_classes, q_evaluation, q_layers, q_modeled, q_ops, q_records, q_zips  # noqa: F401
from demandgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
