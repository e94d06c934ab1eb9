"""Training-data operators: dedup, search, filters, sampling, tokenising.

The subpackage stands alone: no other part of the library imports it.
"""
