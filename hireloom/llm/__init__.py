"""Training-data operators: packing, WARC, de-duplication, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
