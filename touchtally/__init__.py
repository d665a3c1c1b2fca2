"""Marketing attribution and experiment readouts as Spark jobs."""

from touchtally.config import AttributionConfig

__all__ = ["AttributionConfig"]
