"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and the SQL they are compared with.
"""
