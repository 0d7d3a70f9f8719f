"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage. What runs in Python
workers is pickled by value, models too (``massloom.plans.shipping``), so
executors need no copy of the package.
"""
