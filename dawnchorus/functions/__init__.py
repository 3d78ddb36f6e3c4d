"""Column-level helpers: pure expressions, JVM-side, no UDFs."""

from dawnchorus.functions.calendar import (  # noqa: F401
    date_seq, floor_hour, pick, hour24, iso_week, iso_year, season_label, season_ordinal,
    simple_week, to_day, week_start_sunday,
)
from dawnchorus.functions.formatting import de_date, de_number  # noqa: F401
from dawnchorus.functions.geo import haversine_km  # noqa: F401
