"""Overlapping word windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import WS


def chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of word windows that share ``overlap`` words; together they cover the text."""
    found = F.filter(F.split(text, rf"{WS}+"), lambda w: w != "")
    step = size - overlap
    last = F.greatest(F.size(found) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(last / step).cast("int"))
    pieces = F.transform(starts, lambda i: F.array_join(F.slice(found, i * step + 1, F.lit(size)), " "))
    return F.filter(pieces, lambda p: p != "")
