"""Ready-made settings for the two raster kinds, and the cascade built from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.functions.scalar import linear_or_fail
from gridscan.plans.cascade import cascade
from gridscan.schema import POLS, TILE

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Preset:
    """`partial_tiles`: whether ragged right and bottom tiles belong to the grid.  `default_threshold`: whether a
    gate bundle's own threshold may be used; without one the caller must choose, because calibration does not transfer."""
    bands: tuple[str, ...]
    min_valid: float
    partial_tiles: bool
    forest: str
    default_threshold: bool


PRESETS = {
    "single_pol": Preset(("v",), 0.5, True, "single_pol", True),
    "quad_pol": Preset(tuple(p.lower() for p in POLS), 0.99, False, "quad_pol", False),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown raster kind {name!r}; have {sorted(PRESETS)}")
    return PRESETS[name]


def checked_pixels(px: DataFrame, kind: str) -> DataFrame:
    """Band columns present, linear units, 0 and NaN as NULL."""
    p = preset(kind)
    missing = [b for b in p.bands if b not in px.columns]
    if missing:
        raise ValueError(f"{kind} needs the bands {list(p.bands)}; missing {missing}")
    fixed = {}
    for b in p.bands:
        x = linear_or_fail(F.when(~F.isnan(b), F.col(b)), b)
        fixed[b] = F.when(x != 0, x)
    return px.withColumns(fixed)


def build(kind: str, gate: Stage | Column, segment: Stage | Column, bundle: dict | None = None, threshold: float | None = None,
          key: Sequence[str] = TILE) -> Callable[[DataFrame], DataFrame]:
    """A cascade over tiles: N rows in, N rows out."""
    p = preset(kind)
    if threshold is None and p.default_threshold and bundle is not None:
        threshold = bundle.get("threshold")
    if threshold is None:
        raise ValueError(f"{kind} has no default threshold: pass one")
    return lambda tiles, mask_threshold=None: cascade(tiles, gate, segment, threshold, key, mask_threshold)
