"""Operators for preparing training text, each with the query that applies it.

Nothing outside this package imports it; the modules may use the general helpers of
the library. An operator reads the columns it names and leaves other columns alone:
rows travel as one struct, so a column of any name may be present.
"""
