"""Tabular risk features, scoring, retrieval and decision rules as Spark jobs."""
