"""Two-stage cascade and the end-to-end granule plans built from it.

A cheap gate scores every tile, an expensive stage runs on the survivors only, and results are scattered
back: N tiles in, N rows out.  Catalyst never pushes a filter through a Python stage, so the order is written
here explicitly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.functions.scalar import flag
from gridscan.operators.grid import center_crop, crop_window, data_bounds, overlap_tiles, swath_tiles, tile_grid, with_tile
from gridscan.operators.joins import scatter_back
from gridscan.operators.sampling import draw
from gridscan.plans.lineage import settle, stored
from gridscan.schema import GROUNDED, TILE
from gridscan.sources.raster import read_blocks

Stage = Callable[[DataFrame], DataFrame]


def cascade(tiles: DataFrame, gate: Stage | Column, segment: Stage | Column, threshold: float, key: Sequence[str] = TILE,
            mask_threshold: float | None = None, seg: str = "seg", persist: bool = False) -> DataFrame:
    """Tiles with gate_prob, gate_flag and `seg` (NULL off-gate); optionally seg_mask.

    `gate`: column, or function adding `gate_prob`.  `segment`: column, or function adding `seg` to the rows it is
    given.  A column segmenter is evaluated under CASE: no filter, no join.  A function segmenter sees only the
    survivors, redistributed evenly because survivors cluster in space; `persist` keeps the scored frame so the
    gate runs once.
    """
    scored = tiles.withColumn("gate_prob", gate) if isinstance(gate, Column) else gate(tiles)
    scored = scored.withColumn("gate_flag", flag("gate_prob", threshold))
    if isinstance(segment, Column):
        out = scored.withColumn(seg, F.when(F.col("gate_flag"), segment))
    else:
        if persist:
            scored = scored.persist()
        kept = segment(scored.where("gate_flag").repartition(*key))
        out = scatter_back(scored, kept, key, [seg])
    if mask_threshold is not None:
        if dict(out.dtypes)[seg].startswith("array"):
            out = out.withColumn(f"{seg}_mask", F.transform(seg, lambda p: p >= mask_threshold))
        else:
            out = out.withColumn(f"{seg}_mask", flag(seg, mask_threshold))
    return out


def anchored(px: DataFrame, bounds: DataFrame, ts: int) -> DataFrame:
    """Pixels keyed by tiles anchored at each granule's swath corner."""
    b = bounds.select("granule_id", F.col("row_min").alias("_r0"), F.col("col_min").alias("_c0"))
    return with_tile(px.join(b, "granule_id"), ts, "_r0", "_c0").drop("_r0", "_c0")


def candidate_tiles(bounds: DataFrame, ts: int, grounded_px: DataFrame | None = None, min_grounded: float | None = None,
                    max_tiles: int | None = None, seed: int = 0) -> DataFrame:
    """Swath tiles of each granule after the grounded cut and the seeded cap.

    `grounded_px`: number of grounded pixels per tile (TILE, n_grounded); a tile without a row has none.
    """
    if (grounded_px is None) != (min_grounded is None):
        raise ValueError("a surface mask and a minimum grounded fraction must be given together")
    t = swath_tiles(bounds, ts)
    if grounded_px is not None:
        area = F.least(F.lit(ts), F.col("height") - F.col("row")) * F.least(F.lit(ts), F.col("width") - F.col("col"))
        t = t.join(grounded_px.select(*TILE, "n_grounded"), TILE, "left")
        t = t.where(F.coalesce("n_grounded", F.lit(0)) / area >= min_grounded).drop("n_grounded")
    if max_tiles is not None:
        t = draw(t, max_tiles, TILE, seed, by=["granule_id"])
    return t


def scan_granule(px: DataFrame, headers: DataFrame, ts: int, k: int, gate: Stage | Column, segment: Stage, threshold: float,
                 min_valid: float = 0.5, v: str = "v", mask: DataFrame | str | None = None, min_grounded: float | None = None,
                 max_tiles: int | None = None, seed: int = 0, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles, segmented pixels, funnel) of every granule.

    `gate`: an aggregate column over a tile's pixels, computed together with the valid and grounded fractions in
    one pass over the pixels; or a function, pixels of tiles -> one row per tile with `gate_prob`, which only sees
    the valid candidates.  `segment`: pixels of survivors -> the same pixels with `seg`.  `mask`: class column of
    `px`, or another pixel table (granule_id, r, c, cls) on the same grid.
    Tile keys are small; they prune the pixels before each later pass with semi-joins.  `block`: `px` is a
    `write_pixels` layout of such blocks; bounds and scores are then stored when they are known, and the passes
    after them read only the files under the tiles that are left.
    """
    b = data_bounds(px, headers, k, v)
    b = stored(b, "bounds") if block else b
    pix = anchored(px, b, ts)

    def under(tiles: DataFrame) -> DataFrame:
        some = pix if not block else anchored(read_blocks(px, tiles.select(*TILE, F.lit(ts).alias("h"), F.lit(ts).alias("w")), block), b, ts)
        return some.join(tiles.select(*TILE), TILE, "left_semi")

    one_pass = [(F.count_if(F.col(v) > 0) / (ts * ts)).alias("valid_frac")]
    if isinstance(gate, Column):
        one_pass.append(gate.alias("gate_prob"))
    if isinstance(mask, str):
        one_pass.append(F.count_if(F.col(mask) == GROUNDED).alias("n_grounded"))
    stats = pix.groupBy(*TILE).agg(*one_pass)
    if isinstance(mask, DataFrame):
        grounded = anchored(mask.where(F.col("cls") == GROUNDED), b, ts).groupBy(*TILE).agg(F.count(F.lit(1)).alias("n_grounded"))
    else:
        grounded = stats if mask is not None else None
    cand = candidate_tiles(b, ts, grounded, min_grounded, max_tiles, seed)
    scored = stats.where(F.col("valid_frac") >= min_valid).drop("n_grounded").join(cand.select(*TILE), TILE, "left_semi")
    if not isinstance(gate, Column):
        scored = stored(scored, "valid-tiles") if block else scored
        scored = scored.join(gate(under(scored)).select(*TILE, "gate_prob"), TILE, "left")
    scored = scored.withColumn("gate_flag", flag("gate_prob", threshold))
    scored = stored(scored, "scored-tiles") if block else scored
    seg_px = segment(under(scored.where("gate_flag")))
    per = seg_px.groupBy(*TILE).agg(F.avg("seg").alias("seg_mean"))
    tiles = scatter_back(scored, per, TILE, ["seg_mean"])
    c = cand.groupBy("granule_id").agg(F.count(F.lit(1)).alias("candidates"))
    f = scored.groupBy("granule_id").agg(F.count(F.lit(1)).alias("valid"), F.count("gate_prob").alias("scored"), F.count_if("gate_flag").alias("flagged"))
    funnel = c.join(f, "granule_id", "left").na.fill(0, ["valid", "scored", "flagged"])
    return tiles, seg_px, funnel


def full_grid(headers: DataFrame, block: int = 1024) -> DataFrame:
    """Every pixel of every raster: blocks first, spread over the cluster, pixels inside each block after."""
    t = tile_grid(headers, block).select(*TILE, "height", "width").repartition(*TILE)
    t = t.withColumn("r", F.explode(F.sequence(F.col("row"), F.least(F.col("row") + block, F.col("height")) - 1)))
    return t.withColumn("c", F.explode(F.sequence(F.col("col"), F.least(F.col("col") + block, F.col("width")) - 1))).select("granule_id", "r", "c")


def to_source_grid(headers: DataFrame, values: DataFrame, cols: Sequence[str], block: int = 1024) -> DataFrame:
    """Values on the source grid, NULL where nothing was written (never 0)."""
    return full_grid(headers, block).join(values.select("granule_id", "r", "c", *cols), ["granule_id", "r", "c"], "left")


def export_rasters(headers: DataFrame, tiles: DataFrame, seg_px: DataFrame, ts: int, block: int = 1024, area: DataFrame | None = None, margin: int = 0) -> DataFrame:
    """Two aligned rasters: gate_prob over each scored tile's footprint, seg on flagged tiles, NULL elsewhere.

    `tiles`: scored tiles anchored at the corner of `area` (granule_id, row_min, row_max, col_min, col_max), or
    the overlapping reads of `scan_reads` with the same `margin`; without an area, at the smallest corner among
    the tiles.  Every cell of the source grid gets the key of the one tile that owns it (`row`, `col`; NULL
    outside the area), and tiles are joined by that key.  Footprints are clipped to the raster by the grid itself.
    """
    if area is None:
        tiles = settle(tiles.select(*TILE, "gate_prob"))
        area = crop_window(tiles, headers, ts).select("granule_id", F.col("row0").alias("row_min"), (F.col("row0") + F.col("h")).alias("row_max"),
                                                      F.col("col0").alias("col_min"), (F.col("col0") + F.col("w")).alias("col_max"))
    grid = full_grid(headers, block).join(area.select("granule_id", "row_min", "row_max", "col_min", "col_max"), "granule_id", "left")
    grid = grid.select("granule_id", "r", "c", owner("r", "row_min", "row_max", ts, margin).alias("row"), owner("c", "col_min", "col_max", ts, margin).alias("col"))
    g = grid.join(tiles.select(*TILE, "gate_prob"), TILE, "left")
    return g.join(seg_px.select("granule_id", "r", "c", "seg"), ["granule_id", "r", "c"], "left")


def owner(at: str, first: str, end: str, ts: int, margin: int = 0) -> Column:
    """Anchor of the one read that owns a position: the last one that has it `margin` or more from its near side.

    Reads of `ts` stand every ts - 2 * margin from `first` on, while their anchor is before `end`.  The first
    read owns its near side too, the last one all it reaches; positions that no read reaches have no owner.
    """
    stride = ts - 2 * margin
    if stride <= 0:
        raise ValueError("margin must be smaller than half a tile")
    last = F.ceil((F.col(end) - F.col(first)) / stride) - 1
    k = F.least(F.greatest(F.floor((F.col(at) - F.col(first) - margin) / stride), F.lit(0)), last)
    anchor = (F.col(first) + k * stride).cast("int")
    return F.when((F.col(at) >= F.col(first)) & (F.col(at) < anchor + ts), anchor)


def scan_reads(px: DataFrame, headers: DataFrame, ts: int, k: int, gate: Column, segment: Stage, threshold: float, margin: int,
               min_valid: float = 0.5, v: str = "v", mask: str | None = None, min_grounded: float | None = None,
               max_tiles: int | None = None, seed: int = 0, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, seg_px, area) of every granule, scanned by reads that overlap by 2 * `margin`.

    The candidates of `scan_granule` (swath tiles after the grounded cut) span the area of a granule; the area is
    read anew on the finer grid.  Valid fraction and gate decide on whole reads; reads under `min_valid` have no
    row.  `segment` sees all pixels of the flagged reads, and of its result each pixel comes from the one read
    that owns it (`owner`), so no value stems from the edge of a read where a neighbour has it inside.
    `block` as for `scan_granule`.
    """
    b = data_bounds(px, headers, k, v)
    b = stored(b, "bounds") if block else b
    grounded = None
    if mask is not None:
        grounded = anchored(px.where(F.col(mask) == GROUNDED), b, ts).groupBy(*TILE).agg(F.count(F.lit(1)).alias("n_grounded"))
    cand = candidate_tiles(b, ts, grounded, min_grounded, max_tiles, seed)
    reads = overlapped_reads(cand, headers, ts, margin).select(*TILE, "row_min", "row_max", "col_min", "col_max")
    reads = stored(reads, "reads") if block else settle(reads)
    area = reads.select("granule_id", "row_min", "row_max", "col_min", "col_max").distinct()
    pix = pixels_of_reads(px, reads, ts, margin)
    stats = pix.groupBy(*TILE).agg((F.count_if(F.col(v) > 0) / (ts * ts)).alias("valid_frac"), gate.alias("gate_prob"))
    scored = stats.where(F.col("valid_frac") >= min_valid).withColumn("gate_flag", flag("gate_prob", threshold))
    scored = stored(scored, "scored-reads") if block else scored
    kept = scored.where("gate_flag")
    if block:
        px = read_blocks(px, kept.select(*TILE, F.lit(ts).alias("h"), F.lit(ts).alias("w")), block)
        pix = pixels_of_reads(px, reads, ts, margin)
    seg = segment(pix.join(kept.select(*TILE), TILE, "left_semi")).join(area, "granule_id")
    own = (F.col("row") == owner("r", "row_min", "row_max", ts, margin)) & (F.col("col") == owner("c", "col_min", "col_max", ts, margin))
    return scored, seg.where(own).drop("row_min", "row_max", "col_min", "col_max"), area


def export_granule(px: DataFrame, headers: DataFrame, ts: int, k: int, gate: Column, segment: Stage, threshold: float, margin: int = 0,
                   grid_block: int = 1024, **cuts) -> DataFrame:
    """(granule_id, r, c, row, col, gate_prob, seg) on the whole source grid of every granule, scan included.

    Without `margin` the swath tiles are scanned once; with it, overlapping reads.  `cuts` go to the scan.
    """
    if margin:
        reads, seg_px, area = scan_reads(px, headers, ts, k, gate, segment, threshold, margin, **cuts)
        return export_rasters(headers, reads, seg_px, ts, grid_block, area, margin)
    tiles, seg_px, _ = scan_granule(px, headers, ts, k, gate, segment, threshold, **cuts)
    return export_rasters(headers, tiles, seg_px, ts, grid_block)


def overlapped_reads(positions: DataFrame, headers: DataFrame, ts: int, margin: int, parity: bool = False) -> DataFrame:
    """Finer overlapping anchors over the tiles' bounding window, with the part of each read to keep."""
    w = crop_window(positions, headers, ts)
    b = w.select("granule_id", F.col("row0").alias("row_min"), (F.col("row0") + F.col("h")).alias("row_max"),
                 F.col("col0").alias("col_min"), (F.col("col0") + F.col("w")).alias("col_max"))
    b = b.join(headers.select("granule_id", "height", "width"), "granule_id")
    return center_crop(overlap_tiles(b, ts, margin), ts, margin, parity)


def stitch(reads: DataFrame, seg_px: DataFrame) -> DataFrame:
    """Keep from each overlapping read only its own part.  `seg_px`: (granule_id, row, col, r, c, seg) per read."""
    k = reads.select(*TILE, "top", "left", "bottom", "right")
    j = seg_px.join(k, TILE)
    inside = ((F.col("r") >= F.col("row") + F.col("top")) & (F.col("r") < F.col("row") + F.col("bottom"))
              & (F.col("c") >= F.col("col") + F.col("left")) & (F.col("c") < F.col("col") + F.col("right")))
    return j.where(inside).drop("top", "left", "bottom", "right")


def pixels_of_reads(px: DataFrame, reads: DataFrame, ts: int, margin: int) -> DataFrame:
    """Every pixel once per overlapping read that covers it (at most 2 x 2 when the stride is half a tile or more)."""
    stride = ts - 2 * margin
    a = reads.select("granule_id", "row_min", "col_min").distinct().withColumnsRenamed({"row_min": "_r0", "col_min": "_c0"})
    p = px.join(a, "granule_id").where((F.col("r") >= F.col("_r0")) & (F.col("c") >= F.col("_c0")))

    def anchors(x, o):
        d = F.col(x) - F.col(o)
        lo = F.greatest(F.lit(0), F.floor((d - ts) / stride) + 1)
        return F.transform(F.sequence(lo, F.floor(d / stride)), lambda i: (i * stride).cast("int"))
    p = p.withColumn("_a", F.explode(anchors("r", "_r0"))).withColumn("_b", F.explode(anchors("c", "_c0")))
    p = p.withColumn("row", F.col("_r0") + F.col("_a")).withColumn("col", F.col("_c0") + F.col("_b")).drop("_a", "_b", "_r0", "_c0")
    return p.join(reads.select(*TILE), TILE, "left_semi")


def score_new_granules(wide: DataFrame, acceptance: DataFrame, features: Stage, scorers: dict[str, Stage], thresholds: dict[str, float] | None,
                       strict: bool = True, chips: Stage | None = None) -> DataFrame:
    """Acceptance first, then features and chips, then side-by-side scores; no labels needed.

    Every tile of every granule comes back with `accepted`; in a rejected granule all else is NULL and nothing
    is computed.  A granule without a report is not accepted.  strict: a failed granule stops the job instead.
    `features` and `chips`: pixels of accepted granules -> one row per tile.
    """
    from gridscan.operators.checks import verdict
    from gridscan.operators.models import score_side_by_side
    v = verdict(acceptance, ["granule_id"]).select("granule_id", "accepted")
    if strict:
        stop = F.raise_error(F.concat(F.lit("granule failed acceptance: "), F.col("granule_id"))).cast("boolean")
        v = v.where(F.when(F.col("accepted"), F.lit(True)).otherwise(stop))
    tiles = wide.select(*TILE).distinct().join(v, "granule_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    ok = wide.join(v.where("accepted").select("granule_id"), "granule_id", "left_semi")
    scored = score_side_by_side(features(ok), scorers, thresholds)
    out = scatter_back(tiles, scored, TILE, [c for c in scored.columns if c not in TILE])
    if chips is not None:
        cut = chips(ok)
        out = scatter_back(out, cut, TILE, [c for c in cut.columns if c not in TILE])
    return out
