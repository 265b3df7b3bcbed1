"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Every module holds one operator;
``queries`` applies them to the shared tables.
"""
