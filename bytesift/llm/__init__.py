"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; ``bytesift.llm.queries`` lists the
queries that apply each operator to a whole table.
"""
