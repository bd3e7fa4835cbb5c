"""Column roles of a daily panel and the fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Hazards with the months of their season, split names and target shares.
HAZARDS = {"heatwave": (7, 8, 9), "cold_wave": (11, 12)}
SPLITS = ("train", "validation", "test")
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}


@dataclass(frozen=True)
class PanelSpec:
    """Names of the panel columns. One row per (date, region, industry)."""

    date: str = "date"
    region: str = "MCT_SGG_CD"
    industry: str = "MCT_RY_CD"
    measure: str = "TS_AT"
    hazards: dict[str, tuple[int, ...]] = field(default_factory=lambda: dict(HAZARDS))

    @property
    def entity(self) -> tuple[str, str]:
        return (self.region, self.industry)

    @property
    def key(self) -> tuple[str, str, str]:
        return (self.date, self.region, self.industry)


DEFAULT = PanelSpec()
