"""Helpers that shape a plan."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame) -> DataFrame:
    """A boundary for expensive text columns.

    Catalyst pushes a filter through the projection that computes its column and so
    parses the text twice. It does not push through a generator; passing the row
    through one keeps the filter on the finished column.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def observed(seen: Observation, name: str) -> int | None:
    """A metric of a finished action; None where the optimiser left the metrics out with an empty input."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return None
