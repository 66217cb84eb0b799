"""Numbers as SQL has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_round(value: Column | str, places: int) -> Column:
    """A double rounded as SQL does: its product with 10^places, half away from zero. F.round goes by the shortest decimal instead, and differs where the product is a half but the double is not."""
    scale = F.lit(10.0**places)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale
