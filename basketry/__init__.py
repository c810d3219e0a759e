"""Commerce analytics as distributed PySpark DataFrame queries."""
