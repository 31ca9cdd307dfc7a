"""Arrow UDFs that are made when they are called: modules import without a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow_udf(kind: str):
    """Decorator: a function of pandas series as a function of columns with a DDL result type."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap
