"""The fixed thirds by which learned operators hold rows out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
