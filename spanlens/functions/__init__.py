"""Column functions: Column in, Column out, built from Spark's own functions only."""
