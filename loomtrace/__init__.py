"""Loomtrace: a Spark-native engine for agent trajectories and the text memories distilled from them."""

__version__ = "0.1.0"
