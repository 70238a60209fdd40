"""Pixel tables: windowed and multi-band reads, block layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.schema import POLS


def unpivot_bands(wide: DataFrame, bands: Sequence[str] = POLS) -> DataFrame:
    """One column per band -> one row per (pixel, band)."""
    return wide.unpivot(["granule_id", "r", "c"], [b.lower() for b in bands], "band", "v").withColumn(
        "band", F.upper("band"))


def pivot_bands(long: DataFrame, bands: Sequence[str] = POLS) -> DataFrame:
    """One row per pixel with a column per band; the band list is given, so Spark makes no extra pass."""
    return long.groupBy("granule_id", "r", "c").pivot("band", list(bands)).agg(F.max("v"))


# Fixed value: stored layouts depend on it.
PARTS = 32


def granule_part(granule: Column | str = "granule_id") -> Column:
    """The part of a layout that holds a granule: `PARTS` of them, however many granules there are."""
    return F.pmod(F.crc32(granule), F.lit(PARTS)).cast("int")


def write_pixels(px: DataFrame, path: str, block: int = 4096, mode: str = "errorifexists") -> None:
    """Pixels laid out for windowed reads: partitioned by granule part and block row, sorted by granule and block column.

    Rows are spread by (granule part, block row, block column), so no task holds a whole granule, and the number of
    files follows the blocks of a raster, not the number of granules; inside a file, row groups are pruned by granule.
    """
    out = (px.withColumn("granule_part", granule_part())
           .withColumn("block_r", F.floor(F.col("r") / block).cast("int"))
           .withColumn("block_c", F.floor(F.col("c") / block).cast("int")))
    (out.repartition("granule_part", "block_r", "block_c").sortWithinPartitions("granule_part", "block_r", "granule_id", "block_c", "r")
     .write.mode(mode).partitionBy("granule_part", "block_r").parquet(path))


def read_window(px: DataFrame, granule_id: str, row: int, col: int, h: int, w: int, block: int | None = None) -> DataFrame:
    """Pixels of one window; with a blocked layout the block predicates prune partitions and row groups."""
    cond = ((F.col("granule_id") == granule_id) & F.col("r").between(row, row + h - 1)
            & F.col("c").between(col, col + w - 1))
    if block:
        cond = (cond & (F.col("granule_part") == granule_part(F.lit(granule_id)))
                & F.col("block_r").between(row // block, (row + h - 1) // block)
                & F.col("block_c").between(col // block, (col + w - 1) // block))
    return px.where(cond)


def read_blocks(stored: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Pixels of a `write_pixels` layout in the blocks that `windows` (granule_id, row, col, h, w) touch.

    The windows become (granule, block row, block column) keys.  Granule part and block row are partition columns, so
    a small `windows` prunes files while the query runs, by each column on its own; windows of no size, or beyond
    the raster, read nothing.
    """
    def touched(at: str, size: str) -> Column:
        low, high = F.floor(F.col(at) / block).cast("int"), F.floor((F.col(at) + F.col(size) - 1) / block).cast("int")
        return F.explode(F.sequence(low, high))
    # Spark prunes by a table that a comparison has narrowed; this one leaves out windows above or left of the raster.
    some = windows.where((F.col("h") > 0) & (F.col("w") > 0) & (F.col("row") + F.col("h") > 0) & (F.col("col") + F.col("w") > 0))
    keys = some.withColumn("block_r", touched("row", "h")).withColumn("block_c", touched("col", "w")).withColumn("granule_part", granule_part())
    on = ["granule_part", "granule_id", "block_r", "block_c"]
    return stored.join(keys.select(*on).distinct(), on, "left_semi")


def read_windows(px: DataFrame, windows: DataFrame, fill: float | None = 0.0, v: str = "v", block: int | None = None) -> DataFrame:
    """Many boundless windows at once: (granule_id, row, col, h, w) -> every cell, `fill` where there is no pixel.

    Cells outside the raster exist too, as in a boundless read.  An equi-join on (granule_id, r, c); with `block`,
    `px` is a `write_pixels` layout and only the blocks under the windows are read.
    """
    cells = windows.where((F.col("h") > 0) & (F.col("w") > 0)).withColumn("r", F.explode(F.expr("sequence(row, row + h - 1)"))).withColumn(
        "c", F.explode(F.expr("sequence(col, col + w - 1)")))
    if block:
        px = read_blocks(px, windows, block)
    out = cells.join(px.select("granule_id", "r", "c", v), ["granule_id", "r", "c"], "left")
    return out if fill is None else out.withColumn(v, F.coalesce(v, F.lit(fill)))
