"""Registered queries over the given tables, each with its DuckDB equivalent where SQL has one."""
