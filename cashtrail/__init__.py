"""Complaint-risk analytics as Spark DataFrame operators."""
