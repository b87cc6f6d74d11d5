"""Content-quality scoring of marketplace listings as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "plans", "sources"]
