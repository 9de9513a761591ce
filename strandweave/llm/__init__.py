"""Training-data operators: filters, joins, dedup, search, tokenisation and mixing.

Nothing else in the library imports this subpackage.
"""
