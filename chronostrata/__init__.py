"""Analytics over verified, timeline-structured data, written for PySpark."""
