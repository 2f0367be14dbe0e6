"""Panel time-series analytics expressed as Spark DataFrame jobs."""

from tidemark.panel import DAILY, HOURLY, Panel

__all__ = ["DAILY", "HOURLY", "Panel"]
