"""Geometry and road scalars as Column expressions (all inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.0
#: Score of each road class; an absent tag is ``unclassified``, an unknown one scores 1.
ROAD_SCORES = {
    "motorway": 5.0, "trunk": 5.0, "motorway_link": 4.0, "trunk_link": 4.0, "primary": 4.0, "primary_link": 3.5, "secondary": 3.0,
    "secondary_link": 2.5, "tertiary": 2.0, "tertiary_link": 1.5, "residential": 1.0, "unclassified": 1.0, "living_street": 0.5,
}
#: Units of each weight column in a second.
WEIGHT_UNITS = {"travel_time": 1.0, "travel_time_s": 1.0, "travel_time_d": 10.0, "travel_time_c": 100.0, "travel_time_m": 1000.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b, c, d = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    s, t = F.sin((c - a) / 2), F.sin((d - b) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s * s + F.cos(a) * F.cos(c) * t * t))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees: 0 north, 90 east."""
    a, b, c, d = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def deviation(bearings: Column, ideal: Column) -> Column:
    """Smallest angle between any of an array of bearings and ``ideal``; 0 without bearings."""
    turn = lambda b: F.least(F.abs(b - ideal), 360.0 - F.abs(b - ideal))
    return F.coalesce(F.array_min(F.transform(bearings, turn)), F.lit(0.0))


def travel_bound(lat1, lon1, lat2, lon2, v_max_kmh: float = 130.0) -> Column:
    """Deciseconds that the straight line takes at top speed."""
    return haversine(lat1, lon1, lat2, lon2) / (v_max_kmh / 3.6) * 10.0


def first_tag(tags: Column, default: str = "unclassified") -> Column:
    """The first of an array of tags; the default for null and empty arrays."""
    return F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit(default))


def road_score(tag: Column) -> Column:
    """Score of a road class."""
    table = F.create_map(*[F.lit(x) for kv in ROAD_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tag), F.lit(1.0))


def half_even(x: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(x).cast("long")


def units(weight: str) -> float:
    """How many units of a weight column make a second (tenths for an unknown one)."""
    return WEIGHT_UNITS.get(weight, 10.0)


def combined_bound(euclid: Column, learned: Column, safety: float = 1.5) -> Column:
    """The larger of the straight-line bound and the learned estimate over a safety factor."""
    return F.greatest(euclid, F.coalesce(learned, F.lit(0.0)) / F.lit(float(safety)))
