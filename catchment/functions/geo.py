"""Great-circle distance and gravity attraction as native column expressions
(whole-stage codegen, no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km used by the gravity model.
EARTH_RADIUS_KM = 6371.009


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km between two points given in degrees."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    sin_lat, sin_lon = F.sin(half_dlat), F.sin(half_dlon)  # products: a power costs more than all else here
    h = sin_lat * sin_lat + sin_lon * sin_lon * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def gravity(mass, distance) -> Column:
    """Gravity attraction ``mass / distance**2``.

    A zero distance (store and postal code at the same point) yields NULL, so
    the pair takes no part in totals and fails every share cut.
    """
    return F.try_divide(_c(mass), _c(distance) * _c(distance))
