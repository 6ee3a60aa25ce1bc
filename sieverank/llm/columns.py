"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once even where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
