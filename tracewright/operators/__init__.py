"""Operators over DataFrames: spans, groups, batches, rubrics, nested records."""
