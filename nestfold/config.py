"""Run parameters. Everything a run depends on is here or in an ``as_of`` argument."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Destination:
    """A named place listings are measured against."""

    name: str
    lat: float
    lng: float
    gates: bool = False
    score_weight: float = 0.0


@dataclass(frozen=True)
class FilterConfig:
    """Hard and soft listing requirements."""

    price_eur_max: float = 1100.0
    rooms_min: float = 1.5
    rooms_max: float = 3.0
    surface_m2_min: float = 55.0
    elevator_required: bool = False
    photo_required: bool = True
    freshness_days: int = 7
    heating_allowed: tuple[str, ...] = ("centralno", "etazno", "podno")
    furnishing_allowed: tuple[str, ...] = ("furnished", "semi-furnished")
    dishwasher_required: bool = False
    pets_required: bool = True
    max_lease_months: int = 12
    walk_min_max: int = 40

    @classmethod
    def from_dict(cls, raw: dict) -> "FilterConfig":
        """Read the ``filters`` section of a parsed configuration document.

        Only the five structural limits are compulsory; a missing option switches its rule
        off, apart from the photo rule and the lease and walking limits.
        """
        f = raw["filters"]
        return cls(
            price_eur_max=float(f["price_eur_max"]),
            rooms_min=float(f["rooms_min"]),
            rooms_max=float(f["rooms_max"]),
            surface_m2_min=float(f["surface_m2_min"]),
            freshness_days=int(f["freshness_days"]),
            elevator_required=bool(f["elevator_required"]),
            photo_required=bool(f.get("photo_required", True)),
            heating_allowed=tuple(f.get("heating_allowed") or ()),
            furnishing_allowed=tuple(f.get("furnishing_allowed") or ()),
            dishwasher_required=bool(f.get("dishwasher_required", False)),
            pets_required=bool(f.get("pets_required", False)),
            max_lease_months=int(f.get("max_lease_months", 12)),
            walk_min_max=int((f.get("commute") or {}).get("walk_min_max", 40)),
        )


@dataclass(frozen=True)
class MatchConfig:
    """When two listings count as the same flat."""

    max_hamming: int = 6
    coord_decimals: int = 4
    price_bucket_eur: int = 50
    m2_tolerance: float = 1.0
    title_ratio: float = 0.8
    price_pct: float = 0.05


@dataclass(frozen=True)
class WalkConfig:
    """Walking-time lookup: grid size, cache life and the distance pre-check."""

    grid_decimals: int = 3
    ttl_days: int = 90
    km_max: float = 10.0


@dataclass(frozen=True)
class NotifyConfig:
    price_drop_pct: float = 0.05
    renotify_days: int = 14


@dataclass(frozen=True)
class ScoreConfig:
    surface_weight: float = 0.10
    freshness_weight: float = 0.10
    elevator_weight: float = 0.10
    surface_cap_m2: float = 80.0
    walk_cap_min: float = 40.0


@dataclass(frozen=True)
class DigestConfig:
    filters: FilterConfig = field(default_factory=FilterConfig)
    match: MatchConfig = field(default_factory=MatchConfig)
    walk: WalkConfig = field(default_factory=WalkConfig)
    notify: NotifyConfig = field(default_factory=NotifyConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    top_matches: int = 10
    top_near: int = 5
    rejected_shown: int = 30
