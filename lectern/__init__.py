"""Document narration analytics on Spark."""
