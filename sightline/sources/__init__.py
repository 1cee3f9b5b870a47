"""Landed provider replies -> sightings. `REGISTRY` maps a source name to its adapter."""

from .registry import REGISTRY, SOURCE_ORDER, landed, read_sources, source_errors, source_status
from .policy import budget_per_group, fresh_only, within_window
from .verdicts import clean_verdicts, read_verdicts

__all__ = [n for n in dir() if not n.startswith("_")]
