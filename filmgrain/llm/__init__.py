"""Corpus operators over critique texts, shot vectors and page addresses.

Nothing outside this folder imports it. Each operator is a plain function from DataFrames
to a DataFrame; ``queries`` maps the driver tables to them.
"""
