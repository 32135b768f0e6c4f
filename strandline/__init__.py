"""strandline: text and timed-segment analytics on Spark."""
