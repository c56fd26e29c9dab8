"""Operators for preparing training data at scale; nothing else in the library imports this package.

Every operator takes and returns DataFrames and keeps extra columns it is given. ``queries.py`` registers one query per
operator. Intermediate tables are Parquet folders under ``spark.checkpoint.dir`` (:mod:`strata.llm.stored`).
"""
