"""Satisfaction-survey analytics on Spark.

Every report is a ``DataFrame -> DataFrame`` function that groups by all periods at once and
never collects; every normalisation rule is a ``Column -> Column`` function.
"""
