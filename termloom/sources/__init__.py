"""Readers that turn files and tables into corpus DataFrames."""
