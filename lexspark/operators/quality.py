"""The confidence score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(flattened: Column, made: Column, embedded: Column, errors: Column, warnings: Column, infos: Column) -> Column:
    """In thousandths, so that no rounding is involved: every penalty is a whole number of them."""
    layout = F.when(flattened, 80).otherwise(F.least(F.lit(60), made * 5))
    lost = layout + F.least(F.lit(200), embedded * 5) + errors * 180 + warnings * 40 + infos * 5
    return F.greatest(F.lit(0), 1000 - lost) / F.lit(1000.0)
