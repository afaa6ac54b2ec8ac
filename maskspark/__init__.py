"""Declarative data masking for Spark: rules by column, table, role and policy, compiled to DataFrame projections."""

from .conf import EngineConf
from .engine import Engine, MaskedSession, Session

__all__ = ["Engine", "EngineConf", "MaskedSession", "Session"]
