"""Operators over DataFrames. Each takes the time it looks back from as an argument; none reads a clock."""
