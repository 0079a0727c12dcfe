"""Training-data operators: text quality, packing, deduplication, scans and scoring.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with an id and a text column, ignores all other columns, and states in its
docstring what it does with nulls, empty and very long texts, ties and
repeated rows.
"""
