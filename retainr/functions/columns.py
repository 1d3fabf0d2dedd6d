"""Cached column references.

``F.col(name)`` is an unresolved, immutable reference; creating one is a JVM round trip that
costs milliseconds in PySpark 4.  Plans here name the same few dozen columns hundreds of
times, so each name is created once per process and reused.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def col(name: str) -> Column:
    return F.col(name)
