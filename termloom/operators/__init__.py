"""Relational operators: index build, diff, incremental processing, reference checks."""
