"""Event-time market and event data on Spark: bars, books, profiles, features, backtests and quality gates."""

from tidemark.session import session

__all__ = ["session"]
