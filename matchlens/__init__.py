"""Match metrics over action logs of many real-time-strategy matches, on Spark."""

from matchlens.sources.tables import MatchTables

__all__ = ["MatchTables"]
