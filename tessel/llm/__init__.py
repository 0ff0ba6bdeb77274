"""Operators for preparing large training corpora.

Nothing outside this package imports it; ``tessel.llm.queries`` lists the
queries that apply each operator to its whole table.
"""
