"""Edge overlays as column expressions: road classes, closure risk, data confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each road class, 0 the highest.
OSM_RANKS = {
    "motorway": 0, "motorway_link": 0,
    "trunk": 1, "trunk_link": 1,
    "primary": 2, "primary_link": 2,
    "secondary": 3, "secondary_link": 3,
    "tertiary": 4, "tertiary_link": 4,
    "residential": 5, "unclassified": 5,
    "service": 6, "living_street": 6,
}

# Car speed of each road class in km/h.
SPEED_CAR = {
    "motorway": 110.0, "motorway_link": 60.0,
    "trunk": 90.0, "trunk_link": 50.0,
    "primary": 70.0, "primary_link": 45.0,
    "secondary": 60.0, "secondary_link": 40.0,
    "tertiary": 50.0, "tertiary_link": 35.0,
    "residential": 30.0, "unclassified": 40.0,
    "service": 20.0, "living_street": 10.0,
}

UNRANKED = 255
MINOR_RANK = 5
LOW, MODERATE, HIGH, SEVERE = range(4)


def lookup(key: Column, values: dict) -> Column:
    """Value of a fixed table, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def category(label: Column, ranks: dict[str, int] = OSM_RANKS, default: int = UNRANKED) -> Column:
    """Rank of a label."""
    return F.coalesce(lookup(label, ranks), F.lit(default))


def category_at_most(rank: Column, most: int) -> Column:
    """Edges of a rank up to ``most``; edges without one stay."""
    return rank.isNull() | (rank <= most)


def edge_max_elevation(a: Column, b: Column) -> Column:
    """Higher end; the known one if only one is; null if none."""
    return F.greatest(a, b)


def closure_risk(max_elevation: Column, label: Column, moderate: float = 900.0, high: float = 1200.0, severe: float = 1500.0, ranks: dict[str, int] = OSM_RANKS) -> Column:
    """Tier 0 to 3 by elevation and road class; without elevation minor roads are moderate."""
    rank = category(F.when(label != "", label), ranks, MINOR_RANK)
    known = F.when((max_elevation >= severe) & (rank >= 4), SEVERE).when((max_elevation >= high) & (rank >= 3), HIGH).when(max_elevation >= moderate, MODERATE).otherwise(LOW)
    return F.when(max_elevation.isNotNull(), known).when(rank >= MINOR_RANK, MODERATE).otherwise(LOW)


def seasonal_multiplier(tier: Column, moderate: float = 1.0, high: float = 1.5, severe: float = 3.0) -> Column:
    """Weight factor of a tier."""
    return F.when(tier == MODERATE, moderate).when(tier == HIGH, high).when(tier == SEVERE, severe).otherwise(1.0)


def osm_confidence(highway: Column, name: Column, surface: Column, lanes: Column, maxspeed: Column) -> Column:
    """Score in [0, 1] of how well an edge is described by its tags."""
    there = lambda tag, points: F.when(F.length(tag) > 0, points).otherwise(0.0)
    score = 0.2 + F.when(category(highway) <= 3, 0.25).otherwise(0.0) + there(name, 0.2) + there(surface, 0.15) + there(lanes, 0.1) + there(maxspeed, 0.1)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def confidence_multiplier(score: Column) -> Column:
    """Weight factor of a confidence; 1 where there is none."""
    return F.coalesce(2 - score, F.lit(1.0))
