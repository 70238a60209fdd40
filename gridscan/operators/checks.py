"""Acceptance checks as report rows: (..., name, status, measured, bound).

Every suite is a few aggregations whose columns are turned into rows with one `inline`; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridscan.functions.stats import n_true, pearson, share
from gridscan.operators.grid import with_tile
from gridscan.operators.splits import band_split, check_split
from gridscan.operators.stencil import by_tile
from gridscan.plans.lineage import stored
from gridscan.plans.ordering import exact_quantiles
from gridscan.schema import EPSG, GROUND_M, NOISE_FLOOR_DB, POLS, TILE


def _row(name: str, ok: Column, measured: Column, bound: str) -> Column:
    status = F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("fail")
    return F.struct(F.lit(name).alias("name"), status.alias("status"), measured.cast("double").alias("measured"), F.lit(bound).alias("bound"))


def _report(agg: DataFrame, by: Sequence[str], rows: Sequence[Column]) -> DataFrame:
    return agg.select(*by, F.inline(F.array(*rows)))


def verdict(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*by).agg((F.count_if(F.col("status") == "fail") == 0).alias("accepted"), F.count(F.lit(1)).alias("checks"),
                                   F.count_if(F.col("status") == "warn").alias("warnings"))


def acceptance_steps(steps: Sequence[tuple[str, DataFrame | None]]) -> DataFrame:
    """One row per step: position, step, fails, verdict PASS, FAIL or SKIPPED.

    A step is a report (name, status, ...), or None where its inputs are missing.  Steps go in order: after a
    failed one the rest are skipped; one without inputs is skipped itself and holds up none.
    """
    spark = next(r for _, r in steps if r is not None).sparkSession
    rows = None
    for i, (name, report) in enumerate(steps, 1):
        fails = F.count_if(F.col("status") == "fail") if report is not None else F.lit(None).cast("long")
        one = (report if report is not None else spark.range(1)).agg(F.lit(i).alias("position"), F.lit(name).alias("step"), fails.alias("fails"))
        rows = one if rows is None else rows.unionByName(one)
    # One row a step: a handful, whatever the data.
    before = W.partitionBy(F.lit(0)).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.coalesce("fails", F.lit(0))).over(before), F.lit(0)) > 0
    return rows.withColumn("verdict", F.when(stopped | F.col("fails").isNull(), "SKIPPED").when(F.col("fails") > 0, "FAIL").otherwise("PASS"))


def target_checks(px: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """NaN/NULL, range and interior-fraction checks of a soft target."""
    t = F.col(target)
    bad = t.isNull() | F.isnan(t)
    a = px.groupBy(*by).agg(n_true(bad).alias("nan"), F.min(t).alias("lo"), F.max(t).alias("hi"), share((t > 0) & (t < 1)).alias("inner"))
    return _report(a, by, [
        _row("no NaN in targets", F.col("nan") == 0, F.col("nan"), "0"),
        _row("targets in [0,1]", (F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("hi"), "[0,1]"),
        _row("target is continuous", F.col("inner") > 0.05, F.col("inner"), "> 0.05")])


def label_suite(px: DataFrame, tiles: DataFrame, target: str, key: Sequence[str], orient_conc: str, orient_gate: float = 0.12,
                cover_theta: float = 0.2, row: str = "row", col: str = "col") -> DataFrame:
    """Acceptance of a label set: pixels carry the soft target, tiles their position and orientation."""
    cov = px.groupBy(*key).agg(share(F.col(target) > cover_theta).alias("cov"))
    c = _report(cov.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cov") == 0).alias("empty")), [], [
        _row("tile count", F.col("n") > 0, F.col("n"), "> 0"), _row("no all-empty tiles", F.col("empty") == 0, F.col("empty"), "0")])
    dup = tiles.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    d = _report(dup.agg(F.sum(F.col("n") - 1).alias("dup")), [], [_row("no duplicate tile positions", F.col("dup") == 0, F.col("dup"), "0")])
    o = _report(tiles.agg(F.min(orient_conc).alias("m")), [], [
        _row("orientation gate respected", F.col("m").isNull() | (F.col("m") >= orient_gate - 1e-6), F.col("m"), f">= {orient_gate:g}")])
    s = check_split(band_split(tiles, 0.8, 1, (), row, col))
    s = _report(s, [], [_row("train/val spatially separated", F.col("gap") >= 1, F.col("gap"), ">= 1 tile"),
                        _row("both split sides non-empty", (F.col("n_train") > 0) & (F.col("n_val") > 0), F.col("n_train"), "> 0")])
    return target_checks(px, target).unionByName(c).unionByName(d).unionByName(o).unionByName(s)


def granule_suite(wide: DataFrame, headers: DataFrame, mask: DataFrame, label_origin: tuple[float, float], ts: int, min_tiles: int = 50,
                  cross_r: float = 0.99, co_r: float = 0.95, floor_db: float = NOISE_FLOOR_DB, min_valid: float = 0.99,
                  min_grounded: float = 0.95, px_m: float = GROUND_M, epsg: int = EPSG) -> DataFrame:
    """Six acceptance checks per granule: completeness, grid, reciprocity, noise floor, alignment, coverage.

    `wide` is read twice: once per granule for bands and correlations, once per tile for noise and valid fractions; the
    tile table is stored.  Two bands without common pixels have no
    correlation or noise level and fail.
    """
    g = ["granule_id"]
    bands = [p.lower() for p in POLS]
    pairs = (("hv", "vh", cross_r), ("hh", "vv", co_r))

    def correlation(a, b):
        both = (F.col(a) > 0) & (F.col(b) > 0)
        return pearson(F.log10(F.when(both, F.col(a))), F.log10(F.when(both, F.col(b))), 100)
    full = wide.groupBy(*g).agg(sum((F.max(F.col(b).isNotNull().cast("int")) for b in bands), F.lit(0)).alias("n"),
                                *[correlation(a, b).alias(f"r_{a}") for a, b, _ in pairs])
    out = _report(full, g, [_row("completeness", F.col("n") == len(bands), F.col("n"), f"{len(bands)} bands"),
                            *[_row(f"reciprocity {a}/{b}", F.col(f"r_{a}") >= lo, F.col(f"r_{a}"), f">= {lo:g}") for a, b, lo in pairs]])
    dr, dc = (F.col("origin_y") - label_origin[1]) / -F.col("px_m"), (F.col("origin_x") - label_origin[0]) / F.col("px_m")
    frac = F.greatest(F.abs(dr - F.bround(dr)), F.abs(dc - F.bround(dc)))
    out = out.unionByName(_report(headers, g, [
        _row("grid", (F.abs(F.col("px_m") - px_m) <= 1e-6) & (F.col("epsg") == epsg), F.col("px_m"), f"{px_m:g} m, EPSG:{epsg}"),
        _row("label grid alignment", frac <= 1e-4, frac, "integer offset")]))
    cross = (F.col("hv") + F.col("vh")) / 2
    tiles = by_tile(with_tile(wide.select("granule_id", "r", "c", *bands), ts)).groupBy(*TILE).agg(
        (10 * F.log10(F.percentile(cross, F.lit(0.5)))).alias("db"), F.least(*[n_true(F.col(b) > 0) / (ts * ts) for b in bands]).alias("valid_frac"))
    tiles = stored(tiles, "suite-tiles")
    m = F.col("m")
    noise = F.struct(F.lit("noise floor").alias("name"),
                     F.when(m > floor_db + 3, "ok").when(m > floor_db, "warn").otherwise("fail").alias("status"),
                     m.alias("measured"), F.lit(f"> {floor_db:g} dB").alias("bound"))
    med = exact_quantiles(tiles, "db", [0.5], g).select(*g, F.col("q")[0].alias("m"))
    out = out.unionByName(_report(tiles.select(*g).distinct().join(med, g, "left"), g, [noise]))
    gnd = with_tile(mask.where(F.col("cls") == 1), ts).groupBy(*TILE).agg((F.count(F.lit(1)) / (ts * ts)).alias("gf"))
    cov = tiles.join(gnd, TILE, "left").groupBy(*g).agg(n_true((F.col("valid_frac") >= min_valid) & (F.col("gf") >= min_grounded)).alias("n"))
    return out.unionByName(_report(cov, g, [_row("coverage", F.col("n") >= min_tiles, F.col("n"), f">= {min_tiles} tiles")]))


def stored_equals_recomputed(stored: DataFrame, recomputed: DataFrame, key: Sequence[str], value: str, tol: float = 1e-6) -> DataFrame:
    j = stored.select(*key, F.col(value).alias("_a")).join(recomputed.select(*key, F.col(value).alias("_b")), list(key), "full_outer")
    bad = F.col("_a").isNull() | F.col("_b").isNull()
    a = j.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("d"), n_true(bad).alias("missing"), F.count(F.lit(1)).alias("n"))
    return _report(a, [], [_row("stored equals recomputed", (F.col("d") < tol) & (F.col("missing") == 0), F.col("d"), f"< {tol:g}"),
                           _row("same keys", F.col("missing") == 0, F.col("missing"), "0")])


def pinned(funnel: DataFrame, expected: dict[str, int]) -> DataFrame:
    """One row per pinned count of a one-row funnel table."""
    return _report(funnel, [], [_row(k, F.col(k) == v, F.col(k), str(v)) for k, v in expected.items()])
