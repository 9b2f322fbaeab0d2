"""Operators on DataFrames: filters, lanes, fusion, evidence, documents, lifecycle, evaluation."""
