"""Operators of a training-data pipeline: thirteen numbered operators and their registered queries."""
