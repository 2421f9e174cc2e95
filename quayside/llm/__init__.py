"""Training-data operators: deduplication, tokens, packing, scans, classifiers and nearest neighbours.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; Spark deals out
the rows, and the Python inside tasks works on one bounded Arrow block of rows at a time.
"""
