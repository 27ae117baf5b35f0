"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
general interface; ``queries`` holds the thin registered queries and their SQL.
"""
