"""Operators for building training corpora on Spark.

Nothing outside this subpackage imports it; the queries over the test tables are in
:mod:`depquarry.llm.queries`.
"""
