"""Edge tables from Python values."""

from __future__ import annotations

import uuid
from array import array

from pyspark.sql import DataFrame, SparkSession

from ..model import EDGE, KeyKindError, check_node


def from_pairs(spark: SparkSession, pairs) -> DataFrame:
    """Edges of (u, v) pairs, or of a flat array('q') u, v, u, v, ...; integers, strings or UUIDs, one kind."""
    if isinstance(pairs, array):
        if pairs.typecode != "q" or len(pairs) % 2:
            raise ValueError("a flat array of edges holds pairs of 64-bit integers")
        pairs = zip(pairs[::2], pairs[1::2], strict=True)
    rows = [tuple(p) for p in pairs]
    flat = [k for r in rows for k in r]
    text = [isinstance(k, str | uuid.UUID) for k in flat]
    if any(text) and not all(text):
        raise KeyKindError("integer and string keys in one graph")
    if any(text):
        return spark.createDataFrame([tuple(map(str, r)) for r in rows], "src string, dst string").distinct()
    for k in flat:
        check_node(k)
    return spark.createDataFrame(rows, EDGE).distinct()
