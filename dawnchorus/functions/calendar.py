"""Calendar helpers as native Column expressions (whole-stage codegen friendly).

All timestamps are ``timestamp_ntz``; nothing here depends on the session time
zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnchorus.functions.labels import SEASON_MONTHS, SEASONS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_day(ts) -> Column:
    """Calendar date of a timestamp."""
    return F.to_date(_c(ts))


def hour24(ts) -> Column:
    """Hour of day 1..24: midnight (hour 0) is shown as hour 24 of the same date."""
    h = F.hour(_c(ts))
    return F.when(h == 0, F.lit(24)).otherwise(h)


def floor_hour(ts) -> Column:
    """Truncate to the full hour, staying ``timestamp_ntz``.

    ``date_trunc`` returns a session-zone timestamp; building the value from its
    parts keeps it zone-free (no DST gaps).
    """
    t = _c(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                F.lit(0), F.lit(0))


def iso_year(d) -> Column:
    """ISO-8601 week-numbering year."""
    return F.extract(F.lit("YEAROFWEEK"), _c(d)).cast("int")


def iso_week(d) -> Column:
    """ISO-8601 week (Monday start, week 1 holds the first Thursday)."""
    return F.weekofyear(_c(d))


def simple_week(d) -> Column:
    """Non-ISO week: complete 7-day blocks since 1 January, plus one (1..53)."""
    return (F.floor((F.dayofyear(_c(d)) - 1) / 7) + 1).cast("int")


def week_start_sunday(d) -> Column:
    """Start of the week when weeks begin on Sunday (``dayofweek``: Sunday = 1)."""
    d = _c(d)
    return F.date_sub(d, F.dayofweek(d) - 1)


def season_ordinal(ts) -> Column:
    """1 = Frühling, 2 = Sommer, 3 = Herbst, 4 = Winter; NULL for NULL input."""
    m = F.month(_c(ts))
    expr = None
    for i, months in enumerate(SEASON_MONTHS, start=1):
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def pick(idx, values: list) -> Column:
    """``values[idx - 1]`` for a 1-based index column; NULL when out of range or NULL.

    Written as a CASE chain: ``element_at`` over a literal array returned the
    last element for a NULL index after optimisation (Spark 4.1).
    """
    i = F.col(idx) if isinstance(idx, str) else idx
    expr = None
    for n, v in enumerate(values, start=1):
        expr = F.when(i == n, F.lit(v)) if expr is None else expr.when(i == n, F.lit(v))
    return expr


def season_label(ts) -> Column:
    """Meteorological season label of a date or timestamp."""
    return pick(season_ordinal(ts), SEASONS)


def date_seq(start, end) -> Column:
    """Array of every date from ``start`` to ``end`` inclusive."""
    return F.sequence(_c(start), _c(end), F.expr("interval 1 day"))
