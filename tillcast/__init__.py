"""Retail revenue forecasting with gradient-boosted trees on Spark.

The layers, bottom up: ``functions`` build column expressions, ``sources`` read
and write tables, ``operators`` turn DataFrames into DataFrames, ``models`` wrap
Spark ML training and scoring, and ``plans`` compose them into whole jobs.
"""
