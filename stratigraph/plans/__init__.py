"""Registered queries and their SQL, gathered by ``__spark_entry__``."""
