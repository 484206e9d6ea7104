"""Rental-marketplace analytics as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing
reads the wall clock: jobs that need "now" take an explicit ``as_of``.
"""
