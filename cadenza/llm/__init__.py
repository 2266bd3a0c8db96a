"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns DataFrames; nothing else in the
library imports this subpackage.
"""
