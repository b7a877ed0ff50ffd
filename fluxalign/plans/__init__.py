"""Views over the given tables, and whole runs put together from operators."""
