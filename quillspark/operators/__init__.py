"""Relational and order-dependent operators, built on DataFrames."""
