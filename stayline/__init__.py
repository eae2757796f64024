"""Workforce retention analytics as Spark DataFrame plans."""
