"""Marketplace support analytics as Spark DataFrames.

``functions``  column helpers (calendar, casts, predicates, measures)
``operators``  DataFrame -> DataFrame building blocks (generators, interval joins, panels, clones)
``sources``    table and CSV feed readers, dataset writers
``streaming``  once-only loading of arriving feed files
``plans``      the end-to-end datasets
"""
