"""German number and date formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def de_number(x, decimals: int = 0) -> Column:
    """``1234567.891`` -> ``1.234.568`` (``decimals=0``) / ``1.234.567,89`` (2).

    ``format_number`` groups with ``,`` and uses ``.`` as decimal mark (half-even
    rounding); swapping the two marks gives the German style.
    """
    return F.translate(F.format_number(_c(x), decimals), ",.", ".,")


def de_date(d) -> Column:
    """``dd.MM.yyyy``."""
    return F.date_format(_c(d), "dd.MM.yyyy")
