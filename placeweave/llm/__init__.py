"""Operators that prepare text and records for language-model training. Nothing else in the package imports this one."""
