"""Training-data operators: scoring, deduplication, decontamination, mixing.

Nothing else in the library imports this subpackage.
"""
