"""Cohort and registry analytics as Spark DataFrame operators."""
