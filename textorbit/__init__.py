"""Text, vector, fleet, catalog and latency analytics as PySpark DataFrame operators."""
