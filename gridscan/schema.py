"""Table schemas, shared constants and the NULL rule.

NULL is the only "no value" marker inside the engine.  0 and NaN are turned into NULL once, on ingest
(`ingest`), after which every Spark aggregate skips nodata by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, StringType,
    StructField, StructType, TimestampType,
)

# They must equal the data's own conventions.
TILE_PX = 512
GROUND_M = 5.0
TILE_M = 2560.0
EPSG = 3031
POLS = ["HH", "HV", "VH", "VV"]
SEED = 42
GROUNDED = 1
SURFACE_CLASSES = {0: "ocean", 1: "grounded", 2: "transient_shelf", 3: "floating_shelf", 4: "rock"}
NOISE_FLOOR_DB = -27.0

# Key of one tile.  (granule_id, row, col) is the top-left corner in native pixels.
TILE = ["granule_id", "row", "col"]


def _s(*cols: tuple) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


_I, _D, _F, _S = IntegerType(), DoubleType(), FloatType(), StringType()

GRANULES = _s(("granule_id", _S), ("sensor", _S), ("stack", _S), ("foot", _S), ("acq_date", DateType()),
              ("epsg", _I), ("px_m", _D), ("origin_x", _D), ("origin_y", _D), ("height", _I), ("width", _I),
              ("bands", ArrayType(_S)))
PIXELS = _s(("granule_id", _S), ("band", _S), ("r", _I), ("c", _I), ("v", _F))
TILES = _s(("granule_id", _S), ("row", _I), ("col", _I), ("x_m", _D), ("y_m", _D), ("band", _S), ("h", _I),
           ("w", _I), ("data", ArrayType(_F)))
CONTEXT_GRID = _s(("gi", _I), ("gj", _I), ("grounded_frac", _F), ("bedmap_class", ByteType()),
                  ("vel_mean", _F), ("vel_max", _F))
TILE_LABELS = _s(("granule", _S), ("row", _I), ("col", _I), ("label", _S), ("aoi_pos_frac", _D),
                 ("data_frac", _D), ("tier", _S), ("dist_km", _D), ("grounded_frac", _D),
                 ("ice_condition", _S), ("vel_m_yr", _D), ("source", _S), ("timestamp", TimestampType()))
PSEUDO_LABELS = _s(("row", _I), ("col", _I), ("n_lines", _I), ("edge_coverage", _F), ("orient_conc", _F),
                   ("gate_prob", _F),
                   ("ridge_stats", _s(("total_components", _I), ("after_size_filter", _I),
                                      ("after_elongation_filter", _I), ("n_components", _I),
                                      ("total_length", _F), ("coverage", _F), ("mean_response", _F),
                                      ("orient_conc", _F))),
                   ("edge_mask", ArrayType(_F)))
SCORES = _s(("granule", _S), ("row", _I), ("col", _I), ("x_m", _D), ("y_m", _D), ("p_rf", _D),
            ("p_cnn", _D), ("grounded", BooleanType()))


def null_if_nodata(v: Column | str) -> Column:
    """0, negative and NaN become NULL; everything downstream is then nodata-aware."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when((v > 0) & ~F.isnan(v), v)


def null_if_nan(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(v), v)


def ingest(pixels: DataFrame, value: str = "v") -> DataFrame:
    return pixels.withColumn(value, null_if_nodata(value))


def require(cond: Column, value: Column, message: str) -> Column:
    """`value` when `cond` holds, otherwise the job fails with `message` (a data contract, not a filter)."""
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)).cast("string").cast("double"))
