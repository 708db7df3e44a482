"""Training-data operators: PII, quality, near-duplicates, search, packing, mixing.

Nothing else in the library imports this subpackage; it may be deleted with
its tests and the rest keeps working.
"""
