"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

Each module is one operator with its own general interface; ``queries`` and
``oracles`` hold the thin registered queries and their SQL.
"""
