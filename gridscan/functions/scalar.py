"""Scalar column expressions: radiometry, normalisation, label and decision codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from gridscan.schema import SURFACE_CLASSES, null_if_nodata

# Fixed values of the soft target and of the two point-spread axes (degrees).
SOFT_LO, SOFT_HI, RECT_T = 0.08, 0.48, 0.7
PSF_AXES_DEG = (45.0, 135.0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """NULL stays NULL (greatest/least alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def nodata_to_null(v: Column | str) -> Column:
    return null_if_nodata(v)


def to_db(v: Column | str) -> Column:
    """Intensity to dB; nodata gives NULL."""
    return 10 * F.log10(null_if_nodata(v))


def from_db(db: Column | str, amplitude: bool = False) -> Column:
    return F.pow(F.lit(10.0), _c(db) / (20.0 if amplitude else 10.0))


def linear_or_fail(v: Column | str, what: str = "raster") -> Column:
    """Linear data only: a negative value means the input is in dB, and the job stops."""
    v = _c(v)
    msg = f"{what} holds negative values: expected linear units, not dB"
    return F.when(v < 0, F.raise_error(F.lit(msg)).cast("double")).otherwise(v)


def standardise(v: Column | str, mean: Column, sd: Column) -> Column:
    """(v - mean) / sd with nodata at the mean, i.e. 0; a zero sd counts as 1."""
    return F.coalesce((_c(v) - mean) / F.when(sd == 0, 1.0).otherwise(sd), F.lit(0.0))


def co_pol(hh="hh", vv="vv") -> Column:
    return (_c(hh) + _c(vv)) / 2


def cross_pol(hv="hv", vh="vh") -> Column:
    return (_c(hv) + _c(vh)) / 2


def pol_ratio(hh="hh", hv="hv", vh="vh", vv="vv") -> Column:
    return F.try_divide(cross_pol(hv, vh), co_pol(hh, vv))


def soft(resp: Column | str, lo: float = SOFT_LO, hi: float = SOFT_HI) -> Column:
    return clip((_c(resp) - lo) / (hi - lo), 0.0, 1.0)


def rect(x: Column | str, t: float = RECT_T) -> Column:
    return clip((_c(x) - t) / (1.0 - t), 0.0, 1.0)


def soft_target(resp, agreement, t: float = RECT_T) -> Column:
    return soft(resp) * rect(agreement, t)


def log_speed(v: Column | str, floor: float = 1e-3, missing: float | None = None) -> Column:
    """log10 of a speed clamped from below; NULL stays NULL unless `missing` is given."""
    lg = F.log10(F.when(_c(v).isNotNull(), F.greatest(_c(v).cast("double"), F.lit(floor))))
    return lg if missing is None else F.coalesce(lg, F.lit(float(missing)))


def class_name(code: Column | str, names: Mapping[int, str] = SURFACE_CLASSES, default: str = "unknown") -> Column:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(code).cast("int")), F.lit(default))


def odds_fusion(p: Column | str, q: Column | str) -> Column:
    """Odds product of two probabilities.  Diagnostic only: a fused score must not replace either input."""
    p, q = _c(p), _c(q)
    num = p * q
    return num / (num + (1 - p) * (1 - q) + 1e-12)


def fused_equivalent_threshold(theta: float, q: Column | str) -> Column:
    """The plain threshold on p that equals `theta` on the fused score when q is constant."""
    q = _c(q)
    return theta * (1 - q) / (theta * (1 - q) + (1 - theta) * q + 1e-12)


def agreement_code(truth: Column, p: Column | str, theta: float) -> Column:
    """0 unscored, 1 TN, 2 FN, 3 FP, 4 TP."""
    p = _c(p)
    pred = p >= theta
    return (F.when(p.isNull(), 0).when(~truth & ~pred, 1).when(truth & ~pred, 2)
            .when(~truth & pred, 3).otherwise(4))


def blank_reason(valid_frac, grounded_frac, pos_frac, p, min_valid: float, min_grounded: float,
                 pos: float = 0.5, neg: float = 0.05) -> Column:
    """Why a tile shows nothing, later rules winning.

    4 scored; 3 labelled but unscored; 2 ambiguous label; 1 valid but not grounded; 0 nothing to say.
    """
    a = _c(pos_frac)
    ambiguous = (a > neg) & (a < pos)
    return (F.when(ambiguous, 2)
            .when(a.isNotNull() & _c(p).isNotNull(), 4)
            .when(a.isNotNull(), 3)
            .when((_c(valid_frac) >= min_valid) & (_c(grounded_frac) < min_grounded), 1)
            .otherwise(0))


def confusion_class(truth: Column, pred: Column) -> Column:
    return (F.when(truth & pred, "tp").when(truth & ~pred, "fn").when(~truth & pred, "fp").otherwise("tn"))


def robust_align(x, src_center, src_scale, dst_center, dst_scale) -> Column:
    return (_c(x) - _c(src_center)) / _c(src_scale) * _c(dst_scale) + _c(dst_center)


def axis_distance(angle_deg: Column | str, axes: Sequence[float] = PSF_AXES_DEG) -> Column:
    """Distance in degrees, modulo 180, to the nearest of the given axes."""
    a = _c(angle_deg)
    d = [F.least(F.abs(a - x), 180 - F.abs(a - x)) for x in axes]
    return F.least(*d) if len(d) > 1 else d[0]


def clean_granule_id(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"\.tif$", "")


def zero_if_not_grounded(p: Column | str, grounded: Column | str) -> Column:
    """Display policy: a scored tile off grounded ice shows P=0; an unscored one stays NULL."""
    return F.when(_c(p).isNotNull() & ~_c(grounded), F.lit(0.0)).otherwise(_c(p))


def flag(p: Column | str, theta: float | Column) -> Column:
    """Decision at a threshold; an unscoreable tile is never flagged and never dropped."""
    return F.coalesce(_c(p) >= theta, F.lit(False))
