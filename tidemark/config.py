"""All parameters, with the defaults of full-size scenes and a preset for small ones."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Ranks of alerts and of confidence, lowest first.
SEVERITY_ORDER = ("Low", "Moderate", "High", "Critical")
CONFIDENCE_ORDER = ("Low", "Medium", "High")
#: Broad and validated areas as (name, west, east, south, north), in order of precedence.
REGIONS = (("Arabian Gulf", 47.0, 57.0, 22.0, 31.0), ("Red Sea", 32.0, 44.0, 12.0, 30.0))
VALIDATED_REGIONS = (("Arabian Gulf", 48.0, 55.0, 24.0, 30.0), ("Red Sea", 37.0, 42.0, 18.0, 28.0))
OUTSIDE = "Outside all named areas"

# The codes that rejected tiles carry.
INVALID = "invalid_pixel_fraction_above_threshold"
SCREENED = "oil_probability_below_threshold"
BOUNDARY = "boundary_or_nodata_adjacent"


@dataclass(frozen=True)
class Config:
    """The defaults are those of full-size scenes."""

    tile: int = 256
    stride: int = 224
    screener_threshold: float = 0.45
    norm_scope: str = "scene"
    lo_pct: float = 2.0
    hi_pct: float = 98.0
    max_samples: int = 2_000_000
    fixed_lo: float = -30.0
    fixed_hi: float = 0.0
    dark: float = 0.30
    mask: float = 0.10
    opening_radius: int = 2
    min_blob: int = 1000
    connectivity: int = 2
    closing: bool = True
    fill_grid_holes: bool = True
    classical_union: bool = True
    restrict_union: bool = True
    fill_pixel_holes: bool = False
    max_invalid: float = 0.20
    infill: bool = True
    exclude_boundary: bool = False
    confidence_medium: float = 0.26
    confidence_high: float = 0.70
    coast_buffer_deg: float = 2.0
    coast_fallback_deg: float = 5.0
    overlay_alpha: float = 0.42
    rejected_alpha: float = 0.24
    seed: int = 42
    metric_systems: tuple[str, ...] = ("LOCAL_METRIC",)

    def __post_init__(self):
        if not 0 < self.stride <= self.tile:
            raise ValueError("stride must be positive and at most the tile size")
        if self.norm_scope not in ("scene", "tile", "fixed_db"):
            raise ValueError(f"unknown normalisation scope {self.norm_scope!r}")
        if not 0 <= self.lo_pct < self.hi_pct <= 100:
            raise ValueError("percentiles must be ordered within 0 and 100")
        if self.opening_radius < 0 or self.min_blob < 1 or self.connectivity not in (1, 2):
            raise ValueError("morphology parameters are out of range")
        if self.coast_buffer_deg <= 0:
            raise ValueError("the coastline search margin must be positive")


DEFAULT = Config()

#: What learned weights are good for: they were fitted with these values and no others.
OPERATING = (
    "seed", "tile", "stride", "screener_threshold", "mask", "dark", "max_invalid", "infill", "exclude_boundary", "closing", "fill_grid_holes", "classical_union", "restrict_union", "fill_pixel_holes", "opening_radius", "min_blob",
)


def operating_guard(cfg: Config, files: tuple[str, ...] = ()) -> None:
    """Refuses parameters that differ from those of the operating configuration, naming all of them, and weights that aren't there."""
    from pathlib import Path

    if wrong := {name: (getattr(cfg, name), getattr(DEFAULT, name)) for name in OPERATING if getattr(cfg, name) != getattr(DEFAULT, name)}:
        raise ValueError(f"not the operating configuration (given, expected): {wrong}")
    if missing := [f for f in files if not Path(f).exists()]:
        raise FileNotFoundError(f"no weights at {missing}")


#: Tile overlap as in the defaults, for scenes of some hundred pixels.
SMALL = replace(DEFAULT, tile=16, stride=14, min_blob=20, opening_radius=1)
