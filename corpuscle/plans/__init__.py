"""The query catalogue: importing it registers every plan."""

from corpuscle.plans import architecture, boosts, corpus, details, evaluation, graphs, history, picks, ranking, related, resolution, scoring, selection, signals, upkeep  # noqa: F401
from corpuscle.plans.registry import OPERATORS, ORACLES, QUERIES

__all__ = ["OPERATORS", "ORACLES", "QUERIES"]
