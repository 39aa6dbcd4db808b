"""Training-data operators: filtering, deduplication, privacy, packing, search and tokenising.

Nothing else of the library imports this package. Every operator takes and
returns DataFrames; `queries` registers one query per operator.
"""
