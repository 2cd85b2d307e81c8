"""Operators for training-data preparation at corpus scale.

Nothing outside this subpackage imports it; ``queries`` holds the registered
``opN_*`` queries and their DuckDB SQL twins.
"""
