"""Relational operators; every function takes and returns lazy DataFrames unless its docstring says otherwise."""
