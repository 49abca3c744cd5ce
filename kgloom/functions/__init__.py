"""Scalar functions as Column expressions; all are built-in functions that stay in the JVM."""
