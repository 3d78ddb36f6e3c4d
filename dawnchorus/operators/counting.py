"""Row counting that also works on pre-aggregated inputs.

Every count-based operator takes ``weight``: ``None`` counts rows; a column
name sums that column instead.  Fed with a count cube (detections per hour and
species, column ``n``) the operators give the same answers as on the raw
detections while reading a table that is smaller by orders of magnitude.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_rows(weight: str | None = None) -> Column:
    """Number of detections in the group (a long)."""
    if weight is None:
        return F.count(F.lit(1))
    return F.coalesce(F.sum(F.col(weight)), F.lit(0)).cast("long")


def n_where(cond: Column, weight: str | None = None) -> Column:
    """Number of detections in the group that satisfy ``cond``."""
    if weight is None:
        return F.count_if(cond)
    return F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)).cast("long")
