"""Training-data operators: thirteen standalone Spark operators over text tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``queries.py`` registers the thin ``opN_``
queries over the driver tables.
"""
