"""Acceptance of a new granule against a known-good one: a conditional chain of reports.

A step is planned only when its turn comes: after a step that failed, and for a step whose inputs are missing,
nothing is planned and nothing runs.  A report is a handful of rows (name, status, measured, bound); status is
ok, fail, warn (a lead, not a verdict) or info.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscan.operators.features import best_shift, orientation_concentration, regional_concentration
from gridscan.operators.metrics import speckle_table
from gridscan.operators.models import matched_ab

SCHEMA = "position int, step string, verdict string, reason string, name string, status string, measured double, bound string"


@dataclass(frozen=True)
class Step:
    """`report` is called with the inputs named in `needs`; each must hold at least `least` rows of its own."""
    name: str
    needs: Sequence[str]
    report: Callable[..., DataFrame]
    least: Mapping[str, int] | None = None


def chain(spark: SparkSession, steps: Sequence[Step], inputs: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per fact of each step that ran, one row without a fact for each that did not.

    Verdicts: PASS, FAIL (some fact failed), SKIPPED; `reason` names the missing input or the step that failed.
    A step without inputs is skipped and holds up none; after a FAIL all the rest is skipped.
    """
    rows, failed = [], None
    for i, step in enumerate(steps, 1):
        reason = None if failed is None else f"after {failed}"
        for need in step.needs if failed is None else ():
            least = (step.least or {}).get(need, 1)
            given = inputs.get(need)
            if given is None or given.limit(least).count() < least:
                reason = f"lacks {need}"
                break
        if reason is not None:
            rows.append((i, step.name, "SKIPPED", reason, None, None, None, None))
            continue
        facts = step.report(**{n: inputs[n] for n in step.needs}).select("name", "status", "measured", "bound").collect()
        verdict = "FAIL" if any(f["status"] == "fail" for f in facts) else "PASS"
        failed = step.name if verdict == "FAIL" else None
        rows += [(i, step.name, verdict, None, *f) for f in facts]
    return spark.createDataFrame(rows, SCHEMA)


def _facts(df: DataFrame, *facts: tuple[str, Column, Column, str]) -> DataFrame:
    """(name, status, measured, bound) rows from the columns of a one-row table."""
    made = [F.struct(F.lit(n).alias("name"), s.alias("status"), m.cast("double").alias("measured"), F.lit(b).alias("bound")) for n, s, m, b in facts]
    return df.select(F.inline(F.array(*made)))


def _unless(ok: Column, otherwise: str = "fail") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise(otherwise)


def orientation_report(orientations: DataFrame, most: float = 0.7, regions: int = 3, min_tiles: int = 5) -> DataFrame:
    """Tiles (zx, zy) aligned over the whole scene fail; the highest region is context only, as good scenes have high ones too."""
    scene = orientation_concentration(orientations)
    top = regional_concentration(orientations.withColumn("_all", F.lit(1)), ["_all"], regions, min_tiles).agg(F.max("R").alias("R"))
    return _facts(scene, ("scene R", _unless(F.col("R") <= most), F.col("R"), f"<= {most:g}")).unionByName(
        _facts(top, ("highest region R", F.lit("info"), F.col("R"), "context")))


def registration_report(boxes: DataFrame, reach: int = 2, most: float = 1.0) -> DataFrame:
    """Median shift of the boxes (ga, gb, box, br, bc, va, vb) whose peak is the median one or more: weak peaks shift at random."""
    key = [c for c in ("ga", "gb", "box") if c in boxes.columns]
    shifts = best_shift(boxes, reach, key)
    middle = shifts.agg(F.median("peak")).scalar()
    strong = shifts.where(F.col("peak") >= middle).agg(F.median("dy").alias("dy"), F.median("dx").alias("dx"), F.median("peak").alias("peak"))
    return _facts(strong, *[(n, _unless(F.abs(F.col(n)) <= most), F.col(n), f"|shift| <= {most:g} px") for n in ("dy", "dx")],
                  ("peak", F.lit("info"), F.col("peak"), "context"))


def speckle_report(matched: DataFrame, metrics: Sequence[str], new: str, known: str, low: float = 0.67, high: float = 1.5,
                   source: str = "src", key: Sequence[str] = ("k", "row", "col")) -> DataFrame:
    """Ratio of medians, new over known, on the tiles both have: a lead, never a verdict."""
    t = speckle_table(matched, metrics, source, list(key), new, known)
    return t.select(F.concat(F.col("metric"), F.lit(" ratio")).alias("name"), _unless(F.col("ratio").between(low, high), "warn").alias("status"),
                    F.col("ratio").cast("double").alias("measured"), F.lit(f"{low:g} to {high:g}").alias("bound"))


def matched_ab_report(pairs: DataFrame, features: Sequence[str], fold: str, y: str = "y", control_min: float = 0.85, loss_max: float = 0.10, **params) -> DataFrame:
    """The decisive test: a control that scores too low on its own ground fails as well as a test that loses too much.

    Matched tiles whose labels differ (`agree`, where the pairs have it) void the premise: they fail.
    """
    ab = matched_ab(pairs, features, fold, y, control_min, loss_max, **params)
    out = _facts(ab, ("control AUC", _unless(F.col("auc_a") >= control_min), F.col("auc_a"), f">= {control_min:g}"),
                 ("test minus control", _unless(F.col("delta") >= -loss_max), F.col("delta"), f">= -{loss_max:g}"))
    if "agree" in pairs.columns:
        n = pairs.agg(F.count_if(~F.coalesce("agree", F.lit(False))).alias("n"))
        out = _facts(n, ("labels that disagree", _unless(F.col("n") == 0), F.col("n"), "0")).unionByName(out)
    return out


def accept_against(spark: SparkSession, new: str, known: str, orientations: DataFrame, boxes: DataFrame | None, matched: DataFrame | None, pairs: DataFrame | None,
                   metrics: Sequence[str], features: Sequence[str], fold: str, min_shared: int = 100, max_R: float = 0.7, reach: int = 2,
                   max_shift: float = 1.0, **ab) -> DataFrame:
    """The four steps: orientation, registration, speckle, matched A/B, each with its own inputs.

    `orientations`: tiles of the new granule (row, col, zx, zy).  `boxes`: pixels of both in common boxes, none
    without overlap.  `matched`, `pairs`: tiles on shared labelled ground, none without labels; fewer than
    `min_shared` pairs are too few for a readable A/B.
    """
    steps = [
        Step("orientation", ["orientations"], lambda orientations: orientation_report(orientations, max_R)),
        Step("registration", ["boxes"], lambda boxes: registration_report(boxes, reach, max_shift)),
        Step("speckle", ["matched"], lambda matched: speckle_report(matched, metrics, new, known)),
        Step("matched A/B", ["pairs"], lambda pairs: matched_ab_report(pairs, features, fold, **ab), {"pairs": min_shared}),
    ]
    return chain(spark, steps, {"orientations": orientations, "boxes": boxes, "matched": matched, "pairs": pairs})
