"""Great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnchorus.functions.labels import EARTH_RADIUS_KM


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Haversine distance in km between two points given in decimal degrees."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


class SphereGrid:
    """Cells for radius joins: bands of latitude one radius high, each cut into columns of
    longitude at least one radius wide (fewer towards the poles, where a cap is one column)."""

    def __init__(self, within_km: float, radius_km: float = EARTH_RADIUS_KM):
        self.angle = within_km / radius_km * (1 + 1e-9)
        if not 0 < self.angle < math.pi:
            raise ValueError(f"a radius is more than 0 and less than half the globe's girth: {within_km} km")
        self.height = math.degrees(self.angle)
        self.bands = math.ceil(180 / self.height)

    def band(self, lat) -> Column:
        return F.least(F.floor((_c(lat) + 90) / self.height), F.lit(self.bands - 1)).cast("long")

    def _edge(self, band: Column) -> Column:
        """cos of the band's latitude that is farthest from the equator."""
        south, north = band * self.height - 90, (band + 1) * self.height - 90
        far = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
        return F.greatest(F.cos(F.radians(far)), F.lit(0.0))

    def columns(self, band: Column) -> Column:
        return F.greatest(F.floor(self._edge(band) * (360 / self.height)), F.lit(1)).cast("long")

    def column(self, lon, band: Column) -> Column:
        n = self.columns(band)
        return F.pmod(F.floor((_c(lon) + 180) / 360 * n).cast("long"), n)

    def cell(self, lat, lon) -> Column:
        """struct(band, col) of a point; NULL without coordinates."""
        band = self.band(lat)
        return F.when(_c(lat).isNotNull() & _c(lon).isNotNull(), F.struct(band.alias("band"), self.column(lon, band).alias("col")))

    def cells_near(self, lat, lon) -> Column:
        """Every cell that can hold a point within the radius, each once; across the date line and the poles."""
        lat, lon = _c(lat), _c(lon)
        home = self.band(lat)
        bands = F.sequence(F.greatest(home - 1, F.lit(0).cast("long")), F.least(home + 1, F.lit(self.bands - 1).cast("long")))

        def in_band(band: Column) -> Column:
            n = self.columns(band)
            scale = F.sqrt(F.cos(F.radians(lat)) * self._edge(band))
            half = math.sin(self.angle / 2)
            reach = F.when(scale > half, F.degrees(2 * F.asin(F.lit(half) / scale)) + 1e-9).otherwise(F.lit(180.0))
            west = F.floor((lon - reach + 180) / 360 * n).cast("long")
            east = F.least(F.floor((lon + reach + 180) / 360 * n).cast("long"), west + n - 1)
            return F.transform(F.sequence(west, east), lambda c: F.struct(band.alias("band"), F.pmod(c, n).alias("col")))

        return F.when(lat.isNotNull() & lon.isNotNull(), F.flatten(F.transform(bands, in_band)))
