"""Suffix prediction over event logs, as Spark jobs."""
