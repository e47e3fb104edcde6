"""Every query of the engine; importing this module registers them all."""

from tidemark.plans import backtests, bars, features, pricing, profiles, quality, series, terminal, wire
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "backtests", "bars", "features", "pricing", "profiles", "quality", "series", "terminal", "wire"]
