"""Settings of a build, passed explicitly; `from_env` reads what the environment sets."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace


def flag(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Speed:
    """How much work tier 2 does; a sample of 0 takes all pixels."""

    exact_colours: bool
    colour_sample: int
    colour_rounds: int
    word_sample: int
    patch_stride: int
    mixture: int


# Profiles by name, the weights of parts, attributes that search leaves out.
SPEEDS = {
    "quality": Speed(True, 0, 20, 0, 8, 64),
    "balanced": Speed(False, 1800, 16, 4000, 10, 64),
    "fast": Speed(False, 1200, 12, 2500, 12, 48),
}
PART_WEIGHTS = {"head": 0.35, "breast": 0.30, "back_wing": 0.15, "tail": 0.10, "leg": 0.10}
NOT_SEARCHED = ("cattr_fg_aspect_ratio", "cattr_centroid_x", "cattr_centroid_y")


@dataclass(frozen=True)
class Config:
    root: str = "."
    min_images: int = 500
    relax: bool = False
    weights: tuple[float, float, float] = (2.0, 1.0, 1.0)
    pca_dim: int = 448
    dims: tuple[int, int, int] = (512, 256, 512)
    hu_weight: float = 1.0
    full_pool: bool = True  # models and z-scores from all images of the kept classes, not from the kept images alone
    fit_rows: int = 0  # images that tier 2 is fitted on, 0 for all
    stat_rows: int = 2800  # images of the pool that give the z-scores, by a sample in proportion to classes, 0 for all
    speed: str = "quality"
    reuse: bool = True
    rebuild: tuple[str, ...] = ()

    @property
    def profile(self) -> Speed:
        return SPEEDS.get(self.speed, SPEEDS["balanced"])

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ, **given) -> Config:
        found: dict[str, object] = {}
        kinds = {"root": str, "speed": lambda v: v.strip().lower(), "reuse": flag, "relax": flag, "full_pool": flag, "fit_rows": int, "stat_rows": int, "min_images": int, "pca_dim": int, "rebuild": lambda v: tuple(x.strip() for x in v.split(",") if x.strip())}
        for name, read in kinds.items():
            if f"SPARVANE_{name.upper()}" in env:
                found[name] = read(env[f"SPARVANE_{name.upper()}"])
        return replace(Config(), **found, **given)
