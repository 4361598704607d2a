"""Registered queries; importing this package fills the registry."""

from evidquarry.plans import chain, composites, corpus, dialogue, evaluation, evidence, retrieval, routing, structured, text, verification  # noqa: F401
from evidquarry.plans.registry import ORACLES, QUERIES  # noqa: F401
