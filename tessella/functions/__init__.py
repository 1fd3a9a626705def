"""Column functions: everything here takes and returns columns and runs inside Spark's own expressions."""
