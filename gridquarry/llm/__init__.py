"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames.  Text is handled in Arrow batches
inside tasks; joins, counting and grouping are Spark's.  Nothing else in the
library imports this subpackage.
"""
