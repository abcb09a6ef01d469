"""Training-data operators: filters, archives, deduplication, decontamination, mixing and sharding.

Nothing else in the library imports this subpackage.  Operators take and
return DataFrames; ``queries`` holds the thin contract queries.
"""
