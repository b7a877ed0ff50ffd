"""Scalar functions on columns, all JVM-side."""
