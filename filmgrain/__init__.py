"""Shot, colour, motion and timeline analytics as Spark DataFrame operators."""

from filmgrain.config import AnalysisConfig, DEFAULT_CONFIG

__all__ = ["AnalysisConfig", "DEFAULT_CONFIG"]
