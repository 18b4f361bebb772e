"""Endurance-training analytics as PySpark DataFrame operators."""
