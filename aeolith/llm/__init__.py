"""Training-data operators: quality, deduplication, decontamination, privacy and mixing.

Nothing outside this subpackage imports it.  Operators take DataFrames and
column names; the thin queries that bind them to the driver's tables are in
``queries.py``.
"""
