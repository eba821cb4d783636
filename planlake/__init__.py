"""planlake: floor-plan analytics as PySpark DataFrame, SQL and streaming operators."""
