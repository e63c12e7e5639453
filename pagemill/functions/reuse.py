"""Build an expression once per JVM connection and use it in every plan."""

from __future__ import annotations

import functools

from pyspark import SparkContext


def reused(build):
    """Cache the columns a builder returns; they are unresolved, so any plan may use them."""
    memo: dict = {}

    @functools.wraps(build)
    def cached(*args):
        key = (id(SparkContext._gateway), args)
        if key not in memo:
            memo[key] = build(*args)
        return memo[key]

    return cached
