"""Event-panel analytics on Spark."""
