"""Operators of a training-data pipeline: dedup, search, tokens, formats, mixing, filtering.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; `queries.py` registers one `opN_<name>` query per operator.
"""
