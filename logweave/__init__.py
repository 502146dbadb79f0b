"""logweave: a PySpark-native analytics engine for versioned mutation logs.

A table is an append-only log of mutations (puts, wide-column entities, merge
operands, point and range deletions), each with a sequence number.  Every read,
rewrite and analysis of such a log is a DataFrame plan.
"""

__version__ = "0.1.0"
