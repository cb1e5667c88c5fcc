"""Quarterly institutional-holdings analytics as Spark DataFrame plans."""
